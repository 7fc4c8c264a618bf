"""Text and HTML of a summary. Only its small frames are collected."""

from __future__ import annotations

import html
import re

from driftlens.functions import taxonomy

from .study import Summary


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole:.1f}%" if whole else "n/a"


def text_report(s: Summary) -> str:
    """Fixed-width tables: the corpus, kinds by language, breaks, rescue by framing, churn and instability."""
    c = s.corpus.first()
    lines = [f"transitions {c['transitions']}, libraries {c['sources']}; without {c['mass_rename']} mass renames {c['kept']}, {c['kept_sources']}", ""]
    left_out = {r["what"]: r["events"] for r in s.filtered.collect()}
    lines += ["== events left out", f"types of other libraries' headers {left_out.get('third_party') or 0}, symbols of private version nodes {left_out.get('private_node') or 0}", ""]
    rows = s.frequency.collect()
    sizes = {r["language"]: r["n"] for r in s.sizes.collect()}
    mechanisms = {k[0]: k[5] for k in taxonomy.KINDS}
    for language in ("all", "c", "cxx"):
        part = sorted((r for r in rows if r["language"] == language), key=lambda r: r["ord"])
        lines += [f"== changes, {language}", f"{'kind':<32}{'transitions':>12}{'share':>8}{'events':>10}{'median':>9}{'max':>8}  {'verdict':<14}mechanism"]
        lines += [f"{r['kind']:<32}{r['transitions']:>12}{percent(r['transitions'], sizes[language]):>8}{r['events']:>10}{r['median']:>9.1f}{r['most']:>8}  {taxonomy.verdict(mechanisms[r['kind']]):<14}{mechanisms[r['kind']]}" for r in part] + [""]
    b = s.breaks.first()
    lines += ["== binary breaks", f"breaking {b['breaking']} of {b['n']} ({percent(b['breaking'], b['n'])}), declared {b['declared']}, silent {b['silent']}", ""]
    for framing in taxonomy.FRAMINGS:
        table = sorted(s.rescue[framing].collect(), key=lambda r: taxonomy.MECHANISMS.index(r["mechanism"]))
        lines.append(f"== rescue, {framing} framing: affected {table[0]['affected']}, fully rescued {table[0]['fully_rescued']}")
        lines += [f"{r['mechanism']:<36} needed by {r['needed_by']:>6}  sole reason {r['sole_reason']:>6}" for r in table] + [""]
    h = s.churn.first()
    lines += ["== headers", f"with data {h['with_data']}, bodies changed in {h['body_changed']} ({h['body_events']} events), macros in {h['macro_changed']} ({h['macro_changed_nonversion']} without version stamps), poor coverage {h['poor_coverage']}", ""]
    lines += ["== most unstable"] + [f"{r['source']:<40}{r['breaking']:>6} of {r['total']:>6}" for r in s.unstable.collect()]
    return "\n".join(lines) + "\n"


def filled(template: str, values: dict[str, object]) -> str:
    """{{key}} replaced by its escaped value; unknown keys stay visible."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: html.escape(str(values[m[1]])) if m[1] in values else m[0], template)


def frequency_rows(s: Summary, language: str = "all") -> str:
    """Table rows by group, each with a bar relative to the most frequent kind."""
    rows = [r for r in s.frequency.collect() if r["language"] == language]
    top = max((r["transitions"] for r in rows), default=1)
    out = []
    for group in taxonomy.GROUP_ORDER:
        part = sorted((r for r in rows if r["grp"] == group), key=lambda r: r["ord"])
        if part:
            out.append(f'<tr class="group"><th colspan="3">{group}</th></tr>')
        out += [f'<tr><td>{html.escape(r["kind"])}</td><td>{r["transitions"]:,}</td><td><i style="width:{100 * r["transitions"] / top:.0f}%"></i></td></tr>' for r in part]
    return "\n".join(out)


def verdict(share: float, least: float = 0.15) -> str:
    return "Worth it" if share >= least else "Marginal"


def narrative(s: Summary) -> dict[str, str]:
    """Values for a page's keys: verdicts by mechanism, the most unstable libraries, ratios, rows.

    Prevalence of layout and enum changes counts a transition once; the sum over kinds stands beside it.
    """
    evolution = {r["mechanism"]: r for r in s.rescue["evolution"].collect()}
    inline = {r["mechanism"]: r for r in s.rescue["inline"].collect()}
    groups = {r["grp"]: r for r in s.layout_enum.collect()}
    b, h, c = s.breaks.first(), s.churn.first(), s.corpus.first()
    kinds = {r["kind"]: r for r in s.frequency.collect() if r["language"] == "all"}
    fully = next(iter(evolution.values()))["fully_rescued"]

    def row(name: str, mechanism: str, said: str, worth: str) -> str:
        m = (inline if mechanism == taxonomy.INLINE else evolution)[mechanism]
        return f"<tr><td>{name}</td><td>{said}; needed by {m['needed_by']:,} of {m['fully_rescued']:,} rescues, sole reason for {m['sole_reason']:,}</td><td>{worth}</td></tr>"

    share = lambda mechanism: "No data" if not fully else verdict(evolution[mechanism]["needed_by"] / fully)
    in_group = lambda g: f"in {groups[g]['transitions'] if g in groups else 0:,} transitions (summed over kinds {groups[g]['summed_prevalence'] if g in groups else 0:,})"
    bodies = kinds["inline_body_changed"]["transitions"] if "inline_body_changed" in kinds else 0
    tables = kinds["vtable_changed"]["transitions"] if "vtable_changed" in kinds else 0
    verdicts = [
        row("Opaque struct layout", taxonomy.LAYOUT, in_group("Layout"), share(taxonomy.LAYOUT)),
        row("Non-frozen enums", taxonomy.ENUM, in_group("Enums"), share(taxonomy.ENUM)),
        row("Resilient dispatch", taxonomy.DISPATCH, f"in {tables:,} transitions", share(taxonomy.DISPATCH)),
        row("No implicit inlining", taxonomy.INLINE, f"bodies changed in {bodies:,} transitions", "Worth it" if bodies * 20 >= b["n"] else "Marginal"),
    ]
    unstable = s.unstable.collect()
    return {
        "transitions": f"{c['transitions']:,}",
        "libraries": f"{c['sources']:,}",
        "breaking": f"{b['breaking']:,}",
        "breaking_share": percent(b["breaking"], b["n"]),
        "silent_share": percent(b["silent"], b["breaking"]),
        "body_events": f"{h['body_events']:,}",
        "verdicts": "\n".join(verdicts),
        "frequency": frequency_rows(s),
        "rescue": "\n".join(rescue_rows(s, f) for f in taxonomy.FRAMINGS),
        "unstable": "\n".join(f"<li>{html.escape(str(r['source']))}: {r['breaking']:,} of {r['total']:,}</li>" for r in unstable[:8]),
        "unstable_names": ", ".join(str(r["source"]) for r in unstable[:3]),
    }


def rescue_rows(s: Summary, framing: str) -> str:
    table = sorted(s.rescue[framing].collect(), key=lambda r: taxonomy.MECHANISMS.index(r["mechanism"]))
    return "\n".join(f"<tr><td>{framing}</td><td>{r['mechanism']}</td><td>{r['needed_by']:,}</td><td>{r['sole_reason']:,}</td><td>{r['fully_rescued']:,}</td></tr>" for r in table)


#: Keys of narrative() whose values are markup and go in as they are.
MARKUP = ("verdicts", "frequency", "rescue", "unstable")


def page(s: Summary, template: str) -> str:
    values = narrative(s)
    for k in MARKUP:
        template = template.replace("{{" + k + "}}", values[k])
    return filled(template, {k: v for k, v in values.items() if k not in MARKUP})
