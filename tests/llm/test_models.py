import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from driftlens.llm import html_extraction, lm, pii, toxicity

from .helpers import docs, lower


def test_lm_counts_and_scores(spark):
    r = random.Random(3)
    tongues = [[f"{p}{k}" for k in range(40)] for p in ("en", "fr")]
    rows = [(k, " ".join(r.choice(tongues[k % 2]) for _ in range(r.choice((5, 60))))) for k in range(300)] + [(400, None), (401, ""), (None, "null id here"), (7, "EN1 en1"), (402, "unseen words only")]
    got = lm.score_texts(docs(spark, rows), most_words=30).collect()
    tokens = lambda t: [w.encode() for w in lower(t or "").split()] + [b""]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6)) for i, t in rows), key=str)
    assert sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got), key=str) == want
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    assert lm.score_texts(docs(spark, [])).count() == 0


def test_lm_scores_are_those_of_the_model(spark):
    """Score by plain loops over the model's arrays, for held-out and for training texts, and well above the counts alone."""
    r = random.Random(9)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{'aeiou'[k % 5]}" for k in range(600)]
    follow = {w: r.sample(vocab, 4) for w in vocab}

    def text():
        out = [r.choice(vocab)]
        while len(out) < 80:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(k, text()) for k in range(1500)] + [(2000, None), (2001, "never seen words " + "x" * 100 + " here"), (2002, "x" * 100)]
    learned = lm.learn(docs(spark, rows, 2), most_words=700, least_own=20, most_own=400)
    v, m, of = learned.vocab, learned.model, learned.model.members
    assert len(of.unit) == lm.UNITS + 400
    counts = {bytes(x["word"]): x["c"] for x in learned.counts.collect()}
    got = {x["doc_id"]: x for x in lm.scored(learned).collect()}
    softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for i in [3, 4, 5, 6, 7, 8, 9, 2000, 2001, 2002]:
        words = [w.encode() for w in (dict(rows)[i] or "").split()] + [b""]
        known = [v.index.get(w, -1) for w in words]
        codes = [int(v.codes[k]) if k >= 0 else lm.bucket(w) for k, w in zip(known, words, strict=True)]
        total = 0.0
        for at, (c, w) in enumerate(zip(codes, words, strict=True)):
            context = [codes[at - k - 1] if at > k else len(of.unit) for k in range(lm.CONTEXT)]
            q = sum(m.into[x].astype(float) * m.place[k] for k, x in enumerate(context))
            u = int(of.unit[c])
            total += softmax(m.out.astype(float) @ q + m.bias)[u] / math.log(10)
            if lm.WORDS <= u < lm.UNITS - 1:
                first, last = of.begin[u], of.end[u]
                total += softmax(m.own[first:last].astype(float) @ q + m.own_bias[first:last])[of.member[c] - first] / math.log(10)
                if c < lm.UNITS:  # the rest of a bucket, by counts
                    total += math.log10(counts.get(w, 0) + 1) - v.inside[u]
        assert abs(total - got[i]["score"]) < 1e-3 * len(words), i
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] < 1500]
    gain = sum(x["score"] - x["base_score"] for x in held) / sum(x["n_tokens"] for x in held)
    assert gain > 0.3, gain  # log10 a token


def test_lm_learns_and_is_normalised():
    r = np.random.default_rng(1)
    units = np.concatenate([np.where(r.random(1) < 0.5, 0, 60) + r.integers(0, 50, 40) for _ in range(600)])
    units = np.where(r.random(len(units)) < 0.2, lm.UNITS + r.integers(0, 30, len(units)), units)
    own = np.repeat([150, 151, 152], 10)
    members = lm.Members.of(own, np.full(30, 9.0), np.full(lm.UNITS, 4.0))
    starts = np.arange(0, len(units), 40)
    context = lm.contexts(units, starts, len(members.unit))
    assert (context[starts] == lm.UNITS + 30).all() and (context[1, 0], context[1, 1]) == (units[0], lm.UNITS + 30)
    unigram = np.bincount(members.unit[units], minlength=lm.UNITS) + 1.0
    unigram /= unigram.sum()
    model = lm.Model.fresh(unigram, members)
    trainer = lm.Trainer(model, unigram, 5)
    start = model.log_probabilities(context, units).mean()
    for _ in range(6):
        for lo in range(0, len(units), 512):
            trainer.step(context[lo : lo + 512], units[lo : lo + 512])
    again = lm.Model.unpacked(model.packed(), members)
    assert again.log_probabilities(context, units).mean() > start + 0.2
    codes = np.arange(len(members.unit))
    one = np.repeat(context[50:51], len(codes), 0)
    assert abs(np.exp(again.log_probabilities(one, codes)).sum() - 1) < 1e-3


def test_toxicity_chain_on_held_out_rows(spark, tmp_path):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(700):
        ws = [f"w{r.randrange(300)}" for _ in range(r.choice((20, 80)))]
        toxic, low = k % 5 == 0, k % 7 == 0
        if toxic:
            ws.insert(r.randrange(len(ws)), r.choice(("vilename", "nastiest", "nastyone")))
        if low:
            ws = [w + "%%%" for w in ws]
        rows.append((k, " ".join(ws)))
        if k < 500:
            labels.append((k, int(not low), int(toxic)))
    labels += [(3, None, 1), (None, 1, 1), (4, 7, 1), (9999, 1, 1), labels[0]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [*rows, (800, None), (801, ""), (None, "vilename"), (802, "w1 " * 30_000 + "vilename")]
    chain = toxicity.train(docs(spark, more), table, sample=450)
    said = {x["doc_id"]: x for x in toxicity.score(docs(spark, more), chain).collect()}
    held = [k for k in range(500, 700)]
    assert sum(said[k]["toxic"] == (k % 5 == 0) for k in held) >= 198
    assert sum((said[k]["p_low_quality"] > 0.5) == (k % 7 == 0) for k in held) >= 195
    assert not said[800]["toxic"] and not said[801]["toxic"] and said[None]["toxic"] and said[802]["toxic"]
    clean = toxicity.clean(docs(spark, more), chain)
    assert sorted((x["doc_id"] for x in clean.collect()), key=str) == sorted((k for k, x in said.items() if not x["toxic"]), key=str)
    none = toxicity.train(docs(spark, more), table.where("false"))
    assert toxicity.score(docs(spark, more), none).where("toxic").count() == 0
    assert toxicity.score(docs(spark, []), chain).count() == 0


def spans_brute(text):
    out = [(m.start(), m.end(), k) for k, p in pii.PATTERNS.items() for m in p.finditer(text) if pii.valid(k, m[0])]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_the_patterns():
    r = random.Random(8)
    parts = ["a.b@c.d", "@", "x@y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0100", "+", " ", "5", "-", ".", "é", "\n", "a@b@c.de.f", "0.0.0.0.0", "(", "12"]
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert pii.base_spans(text) == spans_brute(text), text


def test_field_on_held_out_sentences(spark):
    weights = pii.train()
    hit = wrong = missed = 0
    for text, gold in pii.generated(300, seed=77):
        found = set(pii.decode(text, pii.candidates(text, 0, len(text)), weights))
        hit, wrong, missed = hit + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.93
    text = "call 4111111111111111 4111111111111111 or mail me: jan (at) host (dot) org, version 3.11.2.7 of 2024-11-12"
    base, all_ = pii.find(text, weights)
    assert [text[s:e] for s, e, k in all_ if k == "card"] == ["4111111111111111"] * 2 and not [b for b in base if b[2] == "card"]
    assert [text[s:e] for s, e, k in all_ if k == "email"] == ["jan (at) host (dot) org"]
    assert set(base) <= set(all_)
    assert pii.redacted("to a@b.cd now", [(3, 9, "email")]) == "to [email] now"
    rows = [(1, "é a@b.cd"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "é a@b.cd"), (4, "9" * 50_000 + " x@y.zz")]
    got = sorted(((x["doc_id"], [(s["kind"], s["start"], s["end"], s["base"]) for s in x["spans"]]) for x in pii.find_personal_data(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, [("email", 2, 8, True)]), (1, [("email", 2, 8, True)]), (2, []), (3, []), (None, [("ip", 0, 7, True)]), (4, [("email", 50_001, 50_007, True)])], key=str)


def test_marked_spans_are_candidates():
    for text, gold in pii.generated(500):
        assert gold <= set(pii.candidates(text, 0, len(text))), text
    weights = pii.train()
    label = "a" * 45
    for span in ("anna.lee (at) host (dot) com", "anna_lee (at) host (dot) com", "info (at) mail (dot) host (dot) org", "anna.lee at host dot co dot uk", "john dot smith at gmail dot com", f"{'m' * 62} (at) host (dot) org", f"anna.lee.of.{label} (at) host (dot) {label} (dot) org", f"anna at {label} dot co dot uk"):
        for text in (f"mail {span}, or ring", f"é a@b.cd write {span}\n then 1.2.3.4"):
            got = [text[s:e] for s, e, k in pii.added_spans(text, pii.base_spans(text), weights)]
            assert got == [span], text
    for text in ("10008907924160 at and. And then", "we met at noon. Then we left", "she sat at home dot", "3.14159 2.71828", "1999-2004", "2024-11-12 10:15:30.123"):
        assert not pii.added_spans(text, pii.base_spans(text), weights), text


_NUMBER = {"phone": re.compile(r"[+(]{0,2}[0-9]+(?:[ .()/+-]{1,3}[0-9]+)*"), "card": re.compile(r"[0-9]+(?:[ .()/+-]{1,3}[0-9]+)*"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}")}
_ADDRESS = re.compile(r"(?:[A-Za-z0-9._%+-]+ ?(?:[(\[]dot[)\]]|(?<= )dot(?= )) ?)*[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]|(?<= )at(?= )) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]|(?<= )dot(?= )) ?[A-Za-z0-9-]+)+")


def exhaustive(text, base, weights):
    """The best score over all sets of disjoint segments, with every piece of the text tried for every kind."""
    taken = [any(s <= i < e for s, e, _ in base) for i in range(len(text))]
    digit = lambda i: 0 <= i < len(text) and text[i] in "0123456789"
    best = [0.0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1]
        for start in range(end):
            span = text[start:end]
            if any(taken[start:end]):
                continue
            n = sum(c in "0123456789" for c in span)
            whole = not (digit(start - 1) and digit(start)) and not (digit(end - 1) and digit(end))
            kinds = [k for k, p in _NUMBER.items() if whole and p.fullmatch(span) and (k == "ip" or pii.SIZES[k][0] <= n <= pii.SIZES[k][1])]
            if (start, end) in addresses_of(text):
                kinds.append("email")
            for k in kinds:
                best[end] = max(best[end], best[start] + sum(weights.get(f, 0.0) for f in pii.features(text, start, end, k)))
    return best[-1]


@functools.cache
def addresses_of(text):
    return {(s, e) for s, e, _ in pii.addresses(text, 0, len(text))}


def test_field_against_an_exhaustive_search():
    weights = pii.train()
    r = random.Random(15)
    parts = ["12", "555", "0100", "4111", "1", " ", " ", "-", ".", "(", ")", "+", "/", "tel ", "card", "a", "bob", " at ", "(at)", "@", " dot ", "(dot)", ".", "com", "x", ", ", "\n", "10.0.0.7", "a@b.cd"]
    some = 0
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(4, 16)))
        base = pii.base_spans(text)
        got = pii.added_spans(text, base, weights)
        if all(a[1] <= b[0] for a, b in zip(base, base[1:])):
            score = sum(sum(weights.get(f, 0.0) for f in pii.features(text, *s)) for s in got)
            assert abs(score - exhaustive(text, tuple(base), weights)) < 1e-6, (text, got)
        some += bool(got)
    assert some > 20
    for text, span in (("bob at host dot com", True), ("a@b", False), ("bob dot lee (at) x (dot) org", True)):  # the lattice's addresses are what the pattern describes
        assert bool(_ADDRESS.fullmatch(text)) == span == ((0, len(text)) in addresses_of(text))


def test_decoding_takes_the_best_disjoint_set():
    text = "x"
    found = [(0, 4, "a"), (3, 8, "b"), (8, 9, "c"), (4, 8, "d")]
    worth = {(0, 4): 1.0, (3, 8): 1.8, (8, 9): 0.1, (4, 8): 0.5}
    real = pii.features
    try:
        pii.features = lambda t, s, e, k: [f"{s}:{e}"]
        got = pii.decode(text, found, {f"{s}:{e}": w for (s, e), w in worth.items()})
    finally:
        pii.features = real
    assert got == [(3, 8, "b"), (8, 9, "c")]


def test_extraction_on_held_out_pages():
    model = html_extraction.trained()
    right = total = 0
    for marked in html_extraction.generated(60, seed=99):
        page = html_extraction.Page(html_extraction._ROLE.sub("", marked))
        roles = iter([int(m[1]) for m in html_extraction._ROLE.finditer(marked)])
        true = [2 if t == "title" else next(roles) for t in page.tag]
        got = html_extraction.decode(page, model.log_probabilities(html_extraction.features(page)))
        for i in range(1, len(got)):  # no contradictions
            assert got[i] in html_extraction._BELOW[got[page.parent[i]]]
        right, total = right + sum(a == b for a, b in zip(got, true, strict=True)), total + len(true)
    assert right / total > 0.97


def test_extraction_of_odd_pages(spark):
    html = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>'
        "<article><h1>The  title &amp; more</h1><p><b>One, two.<br><p>A &lt;b&gt;  <i>word</i>s\n here.</p><script>x</script><p>Last<br>line of the text, with 1 < 2.</p></article>"
        '<div class="comments"><p>A reader says no.</p></div><footer>&copy; me</footer></body>'
    )
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (None, "u", "<p>"), (4, "u", "<" * 3000), (1, "u", html)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "The title & more\nOne, two.\nA <b> words here.\nLast line of the text, with 1 < 2."
    assert [x["text"] for x in got if x["page_id"] == 1] == [text, text]
    assert len(got) == len(rows)
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


_P = (
    "The ferry left the old harbour a little after nine, and most of the passengers had gone below to escape the rain.",
    "Nobody on the island remembers a winter as long as that one, when the mail came only twice between November and March.",
    "By then the lighthouse had been dark for years. Its keeper, a quiet man from the mainland, grew potatoes behind the tower.",
    "What remains today is a stone circle, a few letters, and a song that the children still sing at the end of the summer.",
)
_LINKS = '<a href="/1">Home</a> <a href="/2">Weather</a> <a href="/3">Tickets</a> <a href="/4">Contact us</a>'

#: (html, its text), written by hand; none follows the generator.
HAND_WRITTEN = [
    ("Plain article text without any markup at all, in one line.", "Plain article text without any markup at all, in one line."),
    (f"{_P[0]} It was <b>very</b> cold.<br>{_P[1]}", f"{_P[0]} It was very cold. {_P[1]}"),
    (f"<html><body>{_P[0]}<br><br>{_P[1]}</body></html>", f"{_P[0]} {_P[1]}"),
    (f"<div><div>{_LINKS}</div><div><div>{_P[0]}</div><div>{_P[1]}</div><div>{_P[2]}</div><div>{_P[3]}</div></div><div>{_LINKS}</div></div>", "\n".join(_P)),
    (f"<html><body><div>{_LINKS}</div><div><p>{_P[0]}</p><p>{_P[1]}</p><p>{_P[2]}</p><p>{_P[3]}</p></div><div>{_LINKS}</div></body></html>", "\n".join(_P)),
    (f"<body><article><header><h1>The dark lighthouse</h1></header><p>{_P[2]}</p><p>{_P[3]}</p></article></body>", f"The dark lighthouse\n{_P[2]}\n{_P[3]}"),
    (f'<main><article><h1>A long winter</h1><p>{_P[1]}</p><div class="newsletter-box"><h4>Stay in touch</h4><p>Get our letter every week.</p><form><input type="email"><button>Join</button></form></div><p>{_P[2]}</p></article></main>', f"A long winter\n{_P[1]}\n{_P[2]}"),
    (f'<table width="100%"><tr><td width="150">{_LINKS}</td><td><h1>A song</h1><p>{_P[3]}</p><p>{_P[0]}</p></td></tr></table>', f"A song\n{_P[3]}\n{_P[0]}"),
    (f"<html><body><p>{_P[0]}</p><p>{_P[1]}</p></body></html>", f"{_P[0]}\n{_P[1]}"),
    (f'<body><div id="top-nav"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></div><section><h2>Harbour</h2><p>{_P[0]}</p><ul><li>Bring a coat for the crossing.</li><li>Bring some bread for the birds.</li></ul></section><div class="comment-list"><div class="comment"><b>Ann</b><p>I was there too.</p></div></div><div class="site-footer">&copy; 2020 Island Press</div></body>', f"Harbour\n{_P[0]}\nBring a coat for the crossing.\nBring some bread for the birds."),
]


def test_extraction_of_pages_written_by_hand():
    model = html_extraction.trained()
    got = html_extraction.main_texts([h for h, _ in HAND_WRITTEN], model)
    wrong = [(g, t) for g, (_, t) in zip(got, HAND_WRITTEN, strict=True) if g != t]
    assert not wrong, wrong


def test_boosting_fits_a_simple_rule():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 1] > 0.7, 2, 0))
    model = html_extraction.Boosted(rounds=15).fit(x[:1500], y[:1500])
    logs = model.log_probabilities(x[1500:])
    assert (logs.argmax(1) == y[1500:]).mean() > 0.97
    assert np.allclose(np.exp(logs).sum(1), 1)


def test_query_of_base_counts(spark, tmp_path):
    texts = [(1, "a@b.cd and 1.2.3.4 and 4111111111111111, call +1 (212) 555-0100"), (2, None)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and [got[2][f"n_{k}"] for k in pii.KINDS] == [0] * 4
    spans = "email:0:6,ip:11:18,card:23:39,phone:46:63"
    assert got[1]["spans"] == spans and got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_and_odd_texts_take_linear_time():
    import time

    model, weights = html_extraction.trained(), pii.train()
    began = time.process_time()
    for html in ("<" * 100_000, "<a " * 50_000, "<a href='" * 20_000, "<p><button>" + "<div>" * 40_000, "<table>" + "<tr><td>" * 20_000, "<div>" * 3000 + "x" + "</x>" * 3000, "<p>" * 5000, "&" * 50_000, '<p title="a>' + "b" * 50_000, "<!--" * 20_000):
        html_extraction.main_texts([html], model)
    for text in ("9" * 100_000, "9." * 50_000, "+1(" * 30_000, "a@" * 30_000, "a" * 100_000 + "@", "1 2-3 " * 20_000, "@ 1 " * 20_000, "x@y.zz " * 8_000, "a dot " * 20_000 + "at b dot c", "a at b dot c " * 10_000, "+(" * 40_000):
        pii.find(text, weights)
    assert time.process_time() - began < 60
