import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import scalars, taxonomy


def one(spark, column_of, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column_of("v")).collect()]


def weight(c):
    return -1 if c == "~" else 0 if c == "" else ord(c) if c.isalpha() else ord(c) + 256


def compare(a, b):
    """deb-version(7), character by character."""
    i = j = 0
    while i < len(a) or j < len(b):
        while (i < len(a) and not a[i].isdigit()) or (j < len(b) and not b[j].isdigit()):
            x = weight(a[i] if i < len(a) and not a[i].isdigit() else "")
            y = weight(b[j] if j < len(b) and not b[j].isdigit() else "")
            if x != y:
                return -1 if x < y else 1
            i += i < len(a) and not a[i].isdigit()
            j += j < len(b) and not b[j].isdigit()
        m, n = i, j
        while i < len(a) and a[i].isdigit():
            i += 1
        while j < len(b) and b[j].isdigit():
            j += 1
        x, y = int(a[m:i] or 0), int(b[n:j] or 0)
        if x != y:
            return -1 if x < y else 1
    return 0


def test_fragment_order(spark):
    r = random.Random(1)
    values = ["1.0", "1.1", "1.9", "1.10", "2.0~rc1", "2.0~rc2", "2.0", "1.0+dfsg", "1.0a", "", "0", "00", "~", "a", "1.0-1", "1.0.0"] + ["".join(r.choice("01~+-.:aZ9") for _ in range(r.randint(1, 7))) for _ in range(150)]
    keys = one(spark, scalars.fragment_key, values)
    for a, ka in zip(values, keys, strict=True):
        for b, kb in zip(values, keys, strict=True):
            assert (ka > kb) - (ka < kb) == compare(a, b), (a, b)


def test_version_parts_and_order(spark):
    parts = one(spark, scalars.version_parts, ["1:2.3-4-5", "1.0", "", "x:1.0", "1:", "-1", "2:3", "1.0-"])
    assert [tuple(p) if p else None for p in parts] == [(1, "2.3-4", "5"), (0, "1.0", ""), None, None, None, None, (2, "3", ""), (0, "1.0", "")]
    order = ["1.0", "1.0-1", "1.0-2", "1.1", "3.4.1-1", "3.4.1-1+b1", "9.9", "1:1.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r[0] for r in df.orderBy(scalars.version_key("v")).collect()] == order


@pytest.mark.parametrize(
    ("column_of", "given", "wanted"),
    [
        (scalars.digits_blind, ["libssl3", "a12b345", ""], ["libssl#", "a#b#", ""]),
        (scalars.soname_stem, ["libssl.so.3", "/usr/lib/x/libicuuc.so.72.1", "libfoo.so"], ["libssl", "libicuuc", "libfoo"]),
        (scalars.strip_cv, ["const char *", "char const*volatile", "constant  x", "volatile"], ["char *", "char *", "constant x", ""]),
        (scalars.is_private_node, ["LIBDBUS_PRIVATE_1.16.2", "GLIBC_PRIVATE", "libfoo_internal", "LIBSSL_3_0_0", "", None], [True, True, True, False, False, False]),
        (scalars.is_candidate, ["libssl3", "libssl-dev", "ssl", "libpython3", "libdata"], [True, False, False, False, True]),
        (scalars.is_version_stamp, ["a.h::FOO_VERSION", "a.h::BUF", "version.h::BUF", "X_NUM", "X_NUMB"], [True, False, False, True, False]),
        (scalars.is_safe_path, ["usr/lib", "../x", "/abs", "a/../b", ""], [True, False, False, False, False]),
        (scalars.base_name, ["void Counter::bump(int)", "f", "int f()"], ["Counter::bump", "f", "f"]),
        (scalars.is_compiler_symbol, ["_ZTV1A", "_ZTI1A", "_ZN1A"], [True, True, False]),
        (scalars.language_of_depends, ["libc6, libstdc++6 (>= 9)", "libc6", None], ["cxx", "c", "c"]),
        (scalars.index_stem, ["1:2/3"], ["1%2_3"]),
        (scalars.url_segment, ["a+b:c d/é"], ["a+b:c%20d%2F%C3%A9"]),
        (scalars.is_header_path, ["a/b.h", "usr/include/c++/12/vector", "a/vector", "x.c"], [True, True, False, False]),
    ],
)
def test_scalars(spark, column_of, given, wanted):
    assert one(spark, column_of, given) == wanted


def test_taxonomy(spark):
    rows = [r.asDict() for r in taxonomy.dimension(spark).collect()]
    assert len(rows) == 15 and [r["ord"] for r in rows] == list(range(1, 16))
    for r in rows:  # the framings nest
        assert not r["binary"] or r["evolution"]
        assert not r["evolution"] or r["inline"]
        assert r["absorbed"] == (r["mechanism"] in taxonomy.MECHANISMS)
    assert spark.range(1).select(scalars.percent(F.lit(1), F.lit(0)), scalars.percent(F.lit(1), F.lit(3))).first()[:] == (None, 33.3)
    with pytest.raises(Exception, match="unknown change kind"):
        taxonomy.checked(spark.createDataFrame([("nonsense",)], "kind string")).collect()


def test_names_that_pair_functions(spark):
    said = {
        "void A::f(int)": "A::f",
        "A::A()": "A::A",
        "std::vector<int, std::allocator<int> >::push_back(int const&)": "std::vector<int, std::allocator<int> >::push_back",
        "const T<a, b(c)>& ns::g<void (int)>(T<a, b(c)>) const": "ns::g<void (int)>",
        "bool operator<(A const&, std::vector<int> const&)": "operator<",
        "int F::operator()(int) const": "F::operator()",
        "A::operator bool() const": "A::operator bool",
        "(anonymous namespace)::h(int)": "(anonymous namespace)::h",
        "char* name(void)": "name",
        "plain": "plain",
        "": "",
    }
    assert one(spark, scalars.pairing_name, list(said)) == list(said.values())
    assert one(spark, scalars.pairing_name, [None, "f()"]) == [None, "f"]
    assert one(spark, scalars.peeled_name, ["const char *", "volatile int", None]) == ["char *", "int", "<none>"]


def test_tokens(spark):
    said = {
        "int  f( int a ){return a<<=2;}": "int f ( int a ) { return a <<= 2 ; }",
        'x = "a \\" b" + \'c\'; // end': 'x = "a \\" b" + \'c\' ; // end',
        "1.5e-3f+0x1F->p::q...": "1.5e-3f + 0x1F -> p :: q ...",
        "/* a\nb */ ##": "/* a\nb */ ##",
        "\"open": "\" open",
        "": "",
    }
    assert one(spark, scalars.tokens_of, list(said)) == list(said.values())


def test_reasons():
    assert taxonomy.reason("vtable_changed") == taxonomy.DISPATCH and taxonomy.reason("symbol_added").startswith("additive")
    assert taxonomy.reason("unheard of") == "" and all(taxonomy.reason(k[0]) for k in taxonomy.KINDS)
