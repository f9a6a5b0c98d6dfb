r"""Secret scans: fixed patterns, and a randomness test battery over tokens of an inferred encoding. DataFrame
operations only.

Candidates are maximal runs of [A-Za-z0-9+/] or of [A-Za-z0-9_-], with = only as padding at the end, of LEAST_TOKEN
characters or more with a digit and a letter; so a value after = is tested by itself. A run within one of the other
kind isn't a candidate of its own; runs of the two kinds that merely overlap both are. A candidate's encoding is the
smallest of hex, base32, base36 (lower or upper case), base62, base64 and base64url whose alphabet it keeps to. Under
"each symbol is drawn alike and independently" five tests are made of it: chi-squared uniformity over the alphabet, in
two parts that are independent, between its classes (digits, small letters, capitals and signs) and within them; runs
above and below the alphabet's middle; runs of vowels and other symbols; and serial correlation. Their p-values are
combined by Fisher's method.

A discovery is a candidate that is found not to be random; it is dropped. A document's candidates are a family under the
Benjamini-Hochberg procedure, at a level that falls with a candidate's length: DISCOVERY at LEAST_TOKEN symbols, half of
it at twice as many, since long natural strings are found out all the same. So of true random tokens at most about
DISCOVERY are dropped, fewer of long ones. The rest are reported as `random`, unless they overlap a pattern's span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table

#: Patterns of the kinds, in their order, and the least length of what must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of fewer characters don't match, and no part of such a run would.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST_ASSIGN = 8
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery, and the level of its false-discovery control.
LEAST_TOKEN, DISCOVERY = 20, 0.02
_RUN = "A-Za-z0-9+/_=-"


def _candidate(signs: str, others: str) -> str:
    """Maximal runs of letters, digits and `signs`, with = at their end."""
    own = f"A-Za-z0-9{signs}"
    return rf"(?<![{own}])(?=[A-Za-z{signs}]*[0-9])(?=[0-9{signs}]*[A-Za-z]){others}(?:[{own}]{{{LEAST_TOKEN},}}(?:=+(?![{_RUN}]))?|(?=[={own}]{{{LEAST_TOKEN}}})[{own}]++=+(?![{_RUN}]))"


#: Runs of base64's symbols with one of its signs, or with no sign of either kind in or beside them; and runs of
#: base64url's with one of its signs.
CANDIDATES = (
    _candidate("+/", "(?:(?=[A-Za-z0-9]*[+/])|(?<![_-])(?=[A-Za-z0-9]+(?![A-Za-z0-9_-])))"),
    _candidate("_-", "(?=[A-Za-z0-9]*[_-])"),
)

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet on: what a token (without = at its end) must match, and the alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("^[0-9A-F]+$", _DIGITS + _LOWER[:6].upper()),
    ("^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _LOWER.upper()),
    ("^[0-9A-Za-z]+$", _LOWER.upper() + _LOWER + _DIGITS),
    ("^[0-9A-Za-z+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
#: Elements of an array that are summed up one by one; longer arrays in groups of so many. Symbols of a token that are
#: made numbers at once.
GROUP, SYMBOLS = 256, 4096
_VOWELS = "aeiouAEIOU"

_SPAN = "array<struct<start:bigint,end:bigint,s:string>>"


def _running(sizes: Column) -> Column:
    """Running sums of an array of longs, the element included, in time close to linear."""
    none = F.array().cast("array<bigint>")

    def sums(part: Column, before: Column) -> Column:
        step = lambda done, x: F.array_append(done, F.coalesce(F.element_at(done, -1), before) + x)
        return F.when(F.size(part) == 0, none).otherwise(F.aggregate(part, none, lambda done, x: F.when(F.size(done) == 0, F.array(before + x)).otherwise(step(done, x))))

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int")), lambda g: F.slice(sizes, g * GROUP + 1, GROUP))
    totals = F.transform(groups, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x))
    before = F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda done, x: F.array_append(done, F.element_at(done, -1) + x))
    return F.when(F.size(sizes) == 0, none).otherwise(F.flatten(F.zip_with(groups, F.slice(before, 1, F.size(groups)), sums)))


def _spans(text: Column, pattern: str, group: int) -> Column:
    """Start, end (code points, exclusive) and a group's text of all leftmost matches that don't overlap."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Between the matches lie the pieces of a split: match k ends where pieces 0..k and matches 0..k have passed.
    between = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s).cast("bigint"))
    own = F.transform(whole, lambda s: F.char_length(s).cast("bigint"))
    ends = _running(F.zip_with(F.slice(between, F.lit(1), F.size(own)), own, lambda a, b: a + b))
    bounds = F.zip_with(ends, own, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    found = F.zip_with(bounds, part, lambda x, s: F.struct(x["start"].alias("start"), x["end"].alias("end"), s.alias("s")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared of df > x) by Wilson and Hilferty."""
    k = 2 / (9 * df)
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - k)) / F.sqrt(k)
    return F.when(z >= 0, _normal_tail(z)).otherwise(1 - _normal_tail(-z))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _coded(token: Column) -> Column:
    """The token without = at its end, and the alphabet of its encoding; null where no encoding fits."""
    bare = F.rtrim(token, F.lit("="))
    alphabet = F.lit(None).cast("string")
    for pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(bare.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    return F.when(alphabet.isNotNull(), F.struct(bare.alias("x"), alphabet.alias("alphabet")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _left(x: Column, symbols: Column) -> Column:
    """Symbols of a string that aren't among the given ones."""
    return F.char_length(F.call_function("translate", x, symbols, F.lit(""))).cast("double")


def _runs(x: Column, high: Column) -> Column:
    """Runs of symbols that are among the given ones or aren't. All symbols are letters, digits and signs; ! marks."""
    marked = F.call_function("translate", x, high, F.repeat(F.lit("!"), F.char_length(high)))
    two = F.regexp_replace(marked, "[^!]", "?")
    turns = lambda pair: (F.char_length(two) - F.char_length(F.replace(two, F.lit(pair), F.lit("")))).cast("double") / 2
    return turns("!?") + turns("?!") + 1


def _products(x: Column, alphabet: Column) -> Column:
    """The sum of products of neighbouring symbols' numbers, SYMBOLS at a time, so that no long array is made."""
    raw = x.cast("binary")
    number = lambda c: (F.position(c, alphabet) - 1).cast("double")

    def block(k: Column) -> Column:
        signs = F.filter(F.split(F.decode(F.substr(raw, k * SYMBOLS + 1, F.lit(SYMBOLS + 1)), "UTF-8"), ""), lambda c: c != "")
        return _let(F.transform(signs, number), lambda v: _total(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b)))

    return _total(F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 2) / SYMBOLS).cast("int")), block))


def _statistics(x: Column, alphabet: Column) -> Column:
    """What the tests need of a string x over an alphabet: sums over symbols, classes, pairs and runs."""
    n, m = F.char_length(x).cast("double"), F.char_length(alphabet)
    symbols = F.filter(F.split(alphabet, ""), lambda c: c != "")
    count = F.transform(symbols, lambda c: n - F.char_length(F.replace(x, c, F.lit(""))))
    high = F.substr(alphabet, (m / 2).cast("int") + 1, m)
    digits, small = F.lit(_DIGITS), F.lit(_LOWER)
    classes = F.array(*[F.struct((n - _left(x, s)).alias("n"), (m - _left(alphabet, s)).cast("double").alias("m")) for s in (digits, small)])
    number = lambda c: (F.position(c, alphabet) - 1).cast("double")
    return F.struct(
        n.alias("n"),
        m.cast("double").alias("m"),
        classes.alias("classes"),
        _total(F.transform(count, lambda c: c * c)).alias("squares"),
        _total(F.transform(count, lambda c, k: c * k)).alias("sum"),
        _total(F.transform(count, lambda c, k: c * k * k)).alias("sum2"),
        (n - _left(x, high)).alias("above"),
        _runs(x, high).alias("runs"),
        (n - _left(x, F.lit(_VOWELS))).alias("vowels"),
        _runs(x, F.lit(_VOWELS)).alias("vowel_runs"),
        number(F.substr(x, F.lit(1), F.lit(1))).alias("first"),
        number(F.substr(x, F.char_length(x), F.lit(1))).alias("last"),
        _products(x, alphabet).alias("products"),
    )


def _runs_tail(n: Column, above: Column, runs: Column, none: Column) -> Column:
    """The p-value of a number of runs; `none` where all symbols are on one side."""
    expected = 2 * above * (n - above) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    return F.when((above == 0) | (above == n), none).when(spread <= 0, 1.0).otherwise(_two_sided((runs - expected) / F.sqrt(spread)))


def _p_value(q: Column) -> Column:
    """The combined p-value of the tests, from _statistics()."""
    n, m = q["n"], q["m"]
    rest = F.struct((n - _total(F.transform(q["classes"], lambda c: c["n"]))).alias("n"), (m - _total(F.transform(q["classes"], lambda c: c["m"]))).alias("m"))
    classes = F.filter(F.concat(q["classes"], F.array(rest)), lambda c: c["m"] > 0)
    between = _total(F.transform(classes, lambda c: (c["n"] - n * c["m"] / m) * (c["n"] - n * c["m"] / m) / (n * c["m"] / m)))
    degrees = F.size(classes).cast("double") - 1
    all_ = m / n * q["squares"] - n
    one_side = F.pow(F.lit(2.0), 1 - n)  # all symbols on one side of the middle
    mean = q["sum"] / n
    variance = q["sum2"] - n * mean * mean
    covariance = q["products"] - mean * (2 * q["sum"] - q["first"] - q["last"]) + (n - 1) * mean * mean
    serial = F.when(variance <= 0, one_side).otherwise(_two_sided((covariance / variance + 1 / n) * F.sqrt(n)))
    tests = [_chi_tail(between, degrees), _chi_tail(F.greatest(all_ - between, F.lit(0.0)), m - 1 - degrees), _runs_tail(n, q["above"], q["runs"], one_side), _runs_tail(n, q["vowels"], q["vowel_runs"], F.lit(1.0)), serial]
    ps = F.transform(F.array(*tests), lambda p: F.log(F.greatest(p, F.lit(1e-300))))
    return _let(-_total(ps), lambda h: F.exp(-h) * (1 + h * (1 + h / 2 * (1 + h / 3 * (1 + h / 4)))))


def _random_tokens(text: Column) -> list:
    """Steps (column name, expression of the row) from a text to its random-looking tokens, each of one name."""
    c = F.col
    tested = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _statistics(t["code"]["x"], t["code"]["alphabet"]).alias("q"))
    length_aware = lambda t: F.struct((_p_value(t["q"]) * t["q"]["n"] / LEAST_TOKEN).alias("p"), t["start"].alias("start"), t["end"].alias("end"))
    below = F.filter(F.sequence(F.lit(1), F.size("_c")), lambda k: F.element_at(c("_c"), k)["p"] <= DISCOVERY * k / F.size("_c"))
    rejected = F.coalesce(F.array_max(below), F.lit(0))
    return [
        ("_c", F.concat(*[_spans(text, pattern, 0) for pattern in CANDIDATES])),
        ("_c", F.transform("_c", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _coded(t["s"]).alias("code")))),
        ("_c", F.transform(F.filter("_c", lambda t: t["code"].isNotNull() & (F.char_length(t["code"]["x"]) >= 2)), tested)),
        ("_c", F.array_sort(F.transform("_c", length_aware))),
        ("_rejected", F.when(F.size("_c") == 0, 0).otherwise(rejected)),
        ("_c", F.slice(c("_c"), c("_rejected") + 1, F.greatest(F.size("_c") - c("_rejected"), F.lit(0)))),
    ]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base (spans of the patterns) and added (spans of the battery) of each row: arrays of structs start,
    kind_no (place in KINDS), end and value (what was found; empty for added ones), in that order.

    Positions are code points of the whole text, ends exclusive. A null text counts as empty and has no spans.
    Repeated rows give repeated results. One narrow pass: no row is moved."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    least = (LEAST_ASSIGN, 0, 0)
    for k, (pattern, group) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0))):
        rows = rows.withColumn(f"_{k}", _spans(t, pattern, group))
    for name, step in _random_tokens(t):
        rows = rows.withColumn(name, step)
    named = lambda k: F.transform(F.filter(f"_{k}", lambda x: F.char_length(x["s"]) >= least[k]), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind_no"), x["end"].alias("end"), x["s"].alias("value")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[named(k) for k in range(3)])))
    free = F.filter("_c", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    added = F.array_sort(F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind_no"), x["end"].alias("end"), F.lit("").alias("value"))))
    return rows.select("doc_id", "base", added.alias("added"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s rows."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))
