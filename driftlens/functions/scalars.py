"""Scalar column functions, all of built-in expressions.

Each takes a Column or the name of one and gives a Column; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts that mark packages and macros.
SIDE_PACKAGE_SUFFIXES = ("dev", "dbg", "dbgsym", "doc", "common", "data", "bin", "utils", "tools")
BINDING_PREFIXES = ("libpython", "libperl", "libruby")
NON_RUNTIME_SUFFIXES = ("dev", "doc", "dbg", "dbgsym", "udeb", "tests", "examples")
FIRST_SURVEY_SUFFIXES = ("dev", "doc", "dbg", "dbgsym", "utils", "tools", "bin", "common", "data", "udeb", "tests", "examples", "devtools", "progs", "client", "server", "runtime", "plugins")
HEADER_EXTENSIONS = ("h", "hpp", "hh", "hxx", "H", "inl", "ipp", "tcc")
CXX_EXTENSIONS = ("hpp", "hh", "hxx", "H", "ipp", "tcc", "inl")
CXX_MARKER = r"^\s*(template\s*<|namespace\s+\w|class\s+\w+\s*[:{]|#include\s*<(string|vector|iostream|memory|functional)>)"
VERSION_STAMPS = ("VERSION", "_DATE", "BUILD", "REVISION", "RELEASE", "PATCHLEVEL", "COMMIT", "GIT", "SVN", "HASH", "_YEAR", "_MONTH", "TIMESTAMP", "COPYRIGHT", "MAJOR", "MINOR", "MICRO", "_NUM$", "_STR$")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_blind(c: Column | str) -> Column:
    """Each run of ASCII digits as one ``#``."""
    return F.regexp_replace(col(c), "[0-9]+", "#")


def soname_stem(c: Column | str) -> Column:
    """The file name up to its first ``.so``."""
    return F.substring_index(F.substring_index(col(c), "/", -1), ".so", 1)


def strip_cv(c: Column | str) -> Column:
    """A type's text without the words const and volatile, single spaces between what is left."""
    named = col(c).contains("const") | col(c).contains("volatile")
    bare = F.when(named, F.regexp_replace(col(c), r"\b(const|volatile)\b", "")).otherwise(col(c))
    return F.trim(F.when(bare.contains("  "), F.regexp_replace(bare, " +", " ")).otherwise(bare))


def peeled_name(text: Column | str, aliased: Column | str | None = None) -> Column:
    """The name of a type as callers write it: of what an alias stands for, where that is known, without const and volatile.

    A missing type, as a constructor's result, is ``<none>``.
    """
    named = col(text) if aliased is None else F.coalesce(col(aliased), col(text))
    return F.coalesce(strip_cv(named), F.lit("<none>"))


def pairing_name(pretty: Column | str) -> Column:
    """The qualified name of a function, without result and parameters, from its readable form.

    Removed and added functions of one such name are a changed signature. Template arguments, which
    may hold blanks and brackets, belong to the name; what follows the last closing bracket does not.
    """
    marked = F.regexp_replace(F.trim(col(pretty)), r"operator\s*\(\)", "operator\x01\x02")
    flat = _without_nested_arguments(F.replace(marked, F.lit("(anonymous namespace)"), F.lit("\x04anonymous\x03namespace\x05")))
    head = F.regexp_extract(flat, r"^(.*?)\(", 1)
    name = F.when(flat.contains("("), head).otherwise(flat)
    name = F.when(name.contains("operator"), F.regexp_extract(name, r"([^\s]*operator.*)$", 1)).otherwise(F.substring_index(F.rtrim(name), " ", -1))
    return F.translate(F.regexp_replace(F.regexp_replace(name, r"^[*&]+", ""), r"\s+$", ""), "\x01\x02\x03\x04\x05", "() ()")


def _without_nested_arguments(c: Column) -> Column:
    """Blanks and round brackets between angle brackets as marks that pairing_name() undoes; up to three levels deep."""
    level = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
    parts = F.regexp_extract_all(c, F.lit(level), F.lit(0))
    marked = F.transform(parts, lambda p: F.translate(p, " ()", "\x03\x04\x05"))
    between = F.split(c, level)
    return F.array_join(F.transform(between, lambda b, k: F.concat(b, F.coalesce(F.get(marked, k), F.lit("")))), "")


#: What a C or C++ lexer takes as one token: comments, literals, numbers, names, then marks, longest first.
TOKEN = r"""//[^\n]*|/\*[\s\S]*?\*/|(?:u8|[uUL])?"(?:\\[^\n]|[^"\\\n])*"|(?:[uUL]|u8)?'(?:\\[^\n]|[^'\\\n])*'|\.?[0-9](?:[eEpP][+-]|'?[0-9A-Za-z_]|\.)*|[A-Za-z_$][A-Za-z0-9_$]*|<=>|\.\.\.|->\*|<<=|>>=|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|##|\.\*|[^\x20\x09-\x0d]"""


def tokens(source: Column | str) -> Column:
    """The tokens of C or C++ source text in order, comments included."""
    return F.regexp_extract_all(col(source), F.lit(TOKEN), F.lit(0))


def tokens_of(source: Column | str) -> Column:
    """The tokens with one space between: texts that differ in white space only are equal."""
    return F.array_join(tokens(source), " ")


def fingerprint(c: Column | str) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(col(c).cast("binary")), 1, 16)


def declaration(name: Column | str, result: Column | str, params: Column | str) -> Column:
    """name|result|param|param..., whose fingerprint tells declarations apart."""
    return F.concat_ws("|", col(name), col(result), F.array_join(col(params), "|"))


def pair_id(source: Column | str, old: Column | str, new: Column | str) -> Column:
    return F.format_string("%s@%s..%s", col(source), col(old), col(new))


def index_stem(version: Column | str) -> Column:
    """A version as a file name."""
    return F.translate(col(version), "/:", "_%")


def is_candidate(name: Column | str) -> Column:
    """A runtime library package: no side package, no language binding."""
    n = col(name)
    return n.startswith("lib") & ~n.rlike(f"-({'|'.join(SIDE_PACKAGE_SUFFIXES)})$") & ~n.rlike(f"^({'|'.join(BINDING_PREFIXES)})")


def is_private_node(node: Column | str) -> Column:
    """A symbol version node that its name marks as private."""
    u = F.upper(col(node))
    return F.coalesce(u.contains("PRIVATE") | u.contains("INTERNAL"), F.lit(False))


def is_compiler_symbol(linkage: Column | str) -> Column:
    """Virtual tables, type information and their names."""
    return col(linkage).rlike("^_ZT[VIST]")


def is_version_stamp(key: Column | str) -> Column:
    """A macro whose name, after the last ``::``, says that its value follows the release."""
    return F.substring_index(col(key), "::", -1).rlike(f"(?i)({'|'.join(VERSION_STAMPS)})")


def is_kept_macro(name: Column | str, value: Column | str, function_like: Column | str) -> Column:
    """A public object-like macro with a value."""
    return ~col(name).startswith("_") & (F.length(F.trim(col(value))) > 0) & ~col(function_like)


def is_safe_path(path: Column | str) -> Column:
    """Relative, without a step up."""
    p = col(path)
    return (p != "") & ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def is_shared_object(path: Column | str, head: Column | str) -> Column:
    """lib*.so* by name and ELF by its first bytes."""
    name = F.substring_index(col(path), "/", -1)
    return name.startswith("lib") & name.contains(".so") & (F.substring(col(head), 1, 4) == F.unhex(F.lit("7F454C46")))


def is_versioned_object(path: Column | str) -> Column:
    """A shared object by name alone, outside of debug folders."""
    p = col(path)
    return p.rlike(r"\.so(\.\d+)*$") & ~p.contains("/debug/")


def has_suffix(name: Column | str, suffixes: tuple[str, ...]) -> Column:
    return col(name).rlike(f"-({'|'.join(suffixes)})$")


def is_header_path(path: Column | str) -> Column:
    """A header by extension, or one without any below a c++ folder."""
    p = col(path)
    return p.rlike(rf"\.({'|'.join(HEADER_EXTENSIONS)})$") | (p.contains("/c++/") & ~F.substring_index(p, "/", -1).contains("."))


def language_of_depends(depends: Column | str) -> Column:
    """c++ libraries depend on its runtime; no line at all means c."""
    return F.when(F.coalesce(col(depends).contains("libstdc++6"), F.lit(False)), "cxx").otherwise("c")


def language_of_header(path: Column | str, content: Column | str, default: str = "c") -> Column:
    """cxx by extension or by a line that only C++ has, else the default."""
    by_name = col(path).rlike(rf"\.({'|'.join(CXX_EXTENSIONS)})$")
    return F.when(by_name | F.coalesce(col(content).rlike(f"(?m){CXX_MARKER}"), F.lit(False)), "cxx").otherwise(default)


def base_name(signature: Column | str) -> Column:
    """The last word before the parameters: ``void A::f(int)`` is ``A::f``."""
    return F.substring_index(F.trim(F.substring_index(col(signature), "(", 1)), " ", -1)


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null for a whole of zero."""
    return F.when(whole != 0, F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1))


def url_segment(c: Column | str) -> Column:
    """Percent-encoded, with + and : kept and spaces as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("%2B"), F.lit("+")), F.lit("%3A"), F.lit(":"))


# Debian versions


def version_parts(version: Column | str) -> Column:
    """struct(epoch, upstream, revision); null if the version isn't one.

    The epoch ends at the first colon, the revision begins after the last hyphen.
    """
    v = col(version)
    colon = F.instr(v, ":")
    epoch = F.when(colon == 0, F.lit(0)).otherwise(F.when(F.substring_index(v, ":", 1).rlike("^[0-9]+$"), F.substring_index(v, ":", 1).try_cast("int")))
    rest = F.when(colon == 0, v).otherwise(F.substr(v, colon + 1))
    hyphen = rest.contains("-")
    upstream = F.when(hyphen, F.regexp_extract(rest, r"^(.*)-[^-]*$", 1)).otherwise(rest)
    revision = F.when(hyphen, F.substring_index(rest, "-", -1)).otherwise(F.lit(""))
    return F.when(epoch.isNotNull() & (F.length(upstream) > 0), F.struct(epoch.alias("epoch"), upstream.alias("upstream"), revision.alias("revision")))


def fragment_key(fragment: Column | str) -> Column:
    """Text whose binary order is that of deb-version(7) for one fragment.

    Each run of other characters is mapped so that a tilde comes before the end,
    letters before the rest; each number is led by its count of digits.
    """
    f = F.when(F.length(col(fragment)) == 0, F.lit("0")).otherwise(col(fragment))
    tokens = F.filter(F.regexp_extract_all(f, F.lit(r"(\D*\d*)"), F.lit(1)), lambda t: t != "")

    def key(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(t, r"(\d*)$", 1), "^0+", "")
        other = F.translate(F.regexp_extract(t, r"^(\D*)", 1), "~+-.:", "\x01{|}\x7f")
        return F.concat(other, F.lit("\x02"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)

    return F.concat(F.array_join(F.transform(tokens, key), ""), F.lit("\x02"))


def version_key(version: Column | str) -> Column:
    """struct(epoch, key, key), which orders whole versions; null for what isn't one."""
    p = version_parts(version)
    return F.when(p.isNotNull(), F.struct(p["epoch"].alias("epoch"), fragment_key(p["upstream"]).alias("upstream"), fragment_key(p["revision"]).alias("revision")))


def is_prerelease(upstream: Column | str) -> Column:
    return col(upstream).contains("~")
