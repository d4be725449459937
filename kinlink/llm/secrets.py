"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame functions alone.

A candidate is a run of 20 or more letters, digits and marks of base64. Its encoding is inferred: the smallest alphabet that has its
symbols. Against the uniform distribution over that alphabet stand a chi-squared test of the symbol counts, a runs test of the upper
and lower halves, and a lag-one serial correlation, joined by Bonferroni; a candidate that one of them rejects isn't random. That it
is text or an everyday number is tested by the same statistics: as few equal symbols as chi-squared saw come from text with the
chance of a normal tail, as many runs of upper case, lower case and digits with that of a binomial tail (a sharpened Chernoff bound); Fisher's rule
joins the two. The Benjamini-Hochberg rule over the candidates of the whole table, weighted by length, holds the rate of false
discoveries; it ranks by classes of a twentieth of a decade, so one small histogram is all that is gathered. Letters of one case
have their counts alone to speak for them and need some length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
#: Every run counts, and short ones are dropped after, where a short match can stand in a longer one's way.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets: a symbol's place is its number; the second half of each is its upper half.
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
DIGITS = "0123456789"
#: Encodings by their pattern, the smallest first.
ENCODINGS = [
    ("digits", "^[0-9]+$", DIGITS), ("hex", "^[0-9a-f]+$", HEX_LOWER), ("HEX", "^[0-9A-F]+$", HEX_UPPER), ("upper", "^[A-Z]+$", BASE64[:26]), ("lower", "^[a-z]+$", BASE64[26:52]), ("base32", "^[A-Z2-7]+$", BASE32),
    ("lower36", "^[0-9a-z]+$", DIGITS + BASE64[26:52]), ("upper36", "^[0-9A-Z]+$", DIGITS + BASE64[:26]), ("letters", "^[A-Za-z]+$", BASE64[:52]), ("base62", "^[0-9A-Za-z]+$", BASE64[:62]), ("base64", "", BASE64),
]
#: Share of neighbours of different classes (upper, lower, digit; a capital before a small letter counts as small) that text and
#: identifiers are taken to have at most.
TEXT_CHANGES = 0.03
#: Chance of two equal symbols, and of three less the square of that, in text and in everyday numbers.
TEXT_EQUAL, NUMBER_EQUAL = (0.06, 0.0009), (0.25, 0.0)
#: Classes of evidence in a decade.
STEPS = 20


#: Matches whose places are summed together; an array grows by copying, so sums run within a chunk and over chunks.
CHUNK = 256


def _sums(lengths: Column) -> Column:
    """Running sums of an array, each without its own element."""
    grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    zero = F.lit(0).cast("bigint")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    bases = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), start(zero), grow, lambda a: a["out"])
    return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.aggregate(c, start(base), grow, lambda a: a["out"])))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value): leftmost matches without overlap, in code points. The texts between give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    before = _sums(F.transform(both, lambda x: (x["gap"] + F.length(x["value"])).cast("bigint")))
    spans = F.zip_with(both, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by the classical rational approximation (error below 1e-7), for either sign."""

    def tail(z: Column) -> Column:
        def upper(t: Column) -> Column:
            series = reduce(lambda acc, c: (acc + c) * t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), F.lit(0.0))
            return series * F.exp(-z * z / 2) / 2.5066282746310002

        return _let(_let(1 / (1 + 0.2316419 * F.abs(z)), upper), lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return _let(z, tail)


def _squeezed(s: Column, symbols: str) -> Column:
    """Length once repeated symbols stand for one."""
    return F.length(reduce(lambda x, c: F.regexp_replace(x, f"{c}+", c), symbols, s)).cast("double")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def battery(value: Column) -> Column:
    """(n, encoding, p_random, p_text) of a candidate; in proportion to its length."""

    def counted(e: Column) -> Column:
        alphabet = F.lit(BASE64)
        for name, _, symbols in ENCODINGS[:-1]:
            alphabet = F.when(e["encoding"] == name, symbols).otherwise(alphabet)
        return _let(F.struct(e["s"].alias("s"), e["encoding"].alias("encoding"), alphabet.alias("alphabet"), F.length(e["s"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("size")), numbered)

    def numbered(e: Column) -> Column:
        symbols = F.transform(F.split(e["s"], ""), lambda c: F.instr(e["alphabet"], c).cast("double"))
        return _let(symbols, lambda xs: _let(_total(xs) / e["n"], lambda centre: _let(F.transform(xs, lambda x: x - centre), lambda moved: summed(e, xs, moved))))

    def summed(e: Column, xs: Column, moved: Column) -> Column:
        s, n = e["s"], e["n"]
        squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
        bits = F.concat_ws("", F.transform(xs, lambda i: F.when(i > e["size"] / 2, "1").otherwise("0")))
        pairs = F.zip_with(F.slice(moved, 1, F.size(moved) - 1), F.slice(moved, 2, F.size(moved) - 1), lambda x, y: x * y)
        classes = F.translate(s, BASE64, "A" * 26 + "a" * 26 + "0" * 10)  # without marks
        places = F.greatest(F.length(classes).cast("double") - 1, F.lit(1.0))
        changes = F.greatest(_squeezed(F.replace(classes, F.lit("Aa"), F.lit("a")), "Aa0") - 1, F.lit(0.0))
        return _let(
            F.struct(
                n.alias("n"), e["encoding"].alias("encoding"), e["size"].alias("size"), squares.alias("squares"), bits.alias("bits"),
                _total(F.transform(moved, lambda x: x * x)).alias("variance"), _total(pairs).alias("lag"),
                places.alias("places"), F.greatest(F.least(changes / places, F.lit(1 - 1e-9)), F.lit(1e-9)).alias("rate"),
            ),
            decided,
        )

    def decided(v: Column) -> Column:
        n, k, rate = v["n"], v["size"] - 1, v["rate"]
        # text repeats symbols, so only too uneven counts tell; runs and correlation tell on either side
        chi = v["size"] / n * v["squares"] - n
        p_chi = _normal_tail((F.pow(F.greatest(chi / k, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
        ones = F.length(F.replace(v["bits"], F.lit("0"), F.lit(""))).cast("double")
        p_runs = _let(F.struct((2 * ones * (n - ones) / n + 1).alias("mean"), _squeezed(v["bits"], "10").alias("runs")), lambda r: _let((r["mean"] - 1) * (r["mean"] - 2) / (n - 1), lambda spread: F.when(spread > 0, 2 * _normal_tail(F.abs(r["runs"] - r["mean"]) / F.sqrt(spread))).otherwise(0.0)))
        p_serial = F.when(v["variance"] > 0, 2 * _normal_tail(F.abs(v["lag"] / v["variance"] * F.sqrt(n) + 1 / F.sqrt(n)))).otherwise(0.0)
        bound = F.when(rate > TEXT_CHANGES, F.exp(-v["places"] * (rate * F.log(rate / TEXT_CHANGES) + (1 - rate) * F.log((1 - rate) / (1 - TEXT_CHANGES)))) * F.least(F.lit(1.0), rate * (1 - TEXT_CHANGES) / ((rate - TEXT_CHANGES) * F.sqrt(2 * 3.141592653589793 * v["places"] * rate * (1 - rate))))).otherwise(1.0)
        number = v["encoding"] == "digits"
        two, three = (F.when(number, x).otherwise(y) for x, y in zip(NUMBER_EQUAL, TEXT_EQUAL, strict=True))
        pairs = n * (n - 1) / 2
        p_equal = _normal_tail((pairs * two - (v["squares"] - n) / 2) / F.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * three))
        both = F.greatest(p_equal * bound, F.lit(1e-300))
        return F.struct(n.alias("n"), v["encoding"].alias("encoding"), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("p_random"), _let(both, lambda q: q * (1 - F.log(q))).alias("p_text"))

    def inferred(s: Column) -> Column:
        encoding = F.lit(ENCODINGS[-1][0])
        for name, pattern, _ in ENCODINGS[-2::-1]:
            encoding = F.when(s.rlike(pattern), name).otherwise(encoding)
        return _let(F.struct(s.alias("s"), encoding.alias("encoding")), counted)

    return _let(F.regexp_replace(F.rtrim(value, F.lit("=")), "[-_]", "/"), inferred)  # the URL alphabet's marks are base64's


def _mask(spans: Column) -> Column:
    """A string with an x wherever one of the spans (in order, without overlap) is, up to the last."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    return F.array_join(F.zip_with(spans, ends, lambda s, e: F.concat(F.repeat(F.lit(" "), (s["start"] - e).cast("int")), F.repeat(F.lit("x"), (s["end"] - s["start"]).cast("int")))), "")


def _tested(text: Column) -> Column:
    """The candidates with their places and tests."""
    return F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["value"]).alias("t")))


def _step(t: Column) -> Column:
    """The class of a candidate's evidence for its length; the higher the stronger."""
    return F.floor(-STEPS * F.log10(F.greatest(t["p_text"] / t["n"], F.lit(1e-300)))).cast("int")


def cut_step(documents: DataFrame, level: float, *, text: str = "text") -> int | None:
    """The lowest class of evidence that is a discovery at ``level``, by a histogram of at most 6001 classes."""
    every = documents.select(F.explode(_tested(F.coalesce(F.col(text), F.lit("")))["t"]).alias("t"))
    rows = every.groupBy(_step(F.col("t")).alias("step")).agg(F.count("*").alias("tests"), F.sum("t.n").alias("n")).collect()
    tests, length = sum(r.tests for r in rows), sum(r.n for r in rows)
    found, cut = 0, None
    for r in sorted(rows, key=lambda r: -r.step):
        found += r.tests
        if length / tests * 10 ** (-r.step / STEPS) <= level * found / tests:  # weights have mean one over the table
            cut = r.step
    return cut


def scan_secrets(documents: DataFrame, *, text: str = "text", level: float = 0.01, random_at: float = 1e-3) -> DataFrame:
    """``documents`` with secrets: array of (kind, start, end, encoding, p_random, p_text) by start, then kind.

    Kinds are KINDS and ``random``, a run that passes the battery (p_random at least ``random_at``) and is a discovery at ``level``
    among all candidates of the table; a random run overlaps none of the fixed ones. A null text is empty; other columns and repeated
    rows stay. The table is read once for the histogram of evidence and once for the result.
    """
    cut = cut_step(documents, level, text=text)
    source = documents.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    value = lambda m: F.regexp_extract(m["value"], ASSIGN_VALUE, 1)
    fixed = {"assign": F.filter(matches(F.col("__t"), ASSIGN), lambda m: F.length(value(m)) >= 6), "access": matches(F.col("__t"), ACCESS), "hex": matches(F.col("__t"), HEX)}

    def as_spans(kind: str, found: Column) -> Column:
        null = F.lit(None)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), null.cast("string").alias("encoding"), null.cast("double").alias("p_random"), null.cast("double").alias("p_text")))

    out = source.withColumns({f"__{k}": v for k, v in fixed.items()})
    out = out.withColumn("__fixed", F.concat(*(as_spans(k, F.col(f"__{k}")) for k in fixed)))
    discovery = lambda m: (m["t"]["p_random"] >= random_at) & ((_step(m["t"]) >= cut) if cut is not None else F.lit(False))
    out = out.withColumn("__found", F.filter(_tested(F.col("__t")), discovery))
    out = out.withColumn("__masks", F.when(F.size("__found") > 0, F.array(*(_mask(F.col(f"__{k}")) for k in fixed))))
    free = lambda m: ~F.exists("__masks", lambda k: F.contains(F.substring(k, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), F.lit("x")))
    spans = F.transform(F.filter("__found", free), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("order"), m["end"].alias("end"), F.lit("random").alias("kind"), m["t"]["encoding"].alias("encoding"), m["t"]["p_random"].alias("p_random"), m["t"]["p_text"].alias("p_text")))
    every = F.array_sort(F.when(F.size("__found") > 0, F.concat("__fixed", spans)).otherwise(F.col("__fixed")))
    secrets = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"), s["encoding"].alias("encoding"), s["p_random"].alias("p_random"), s["p_text"].alias("p_text")))
    return out.withColumn("secrets", secrets).drop("__t", *(f"__{k}" for k in fixed), "__fixed", "__found", "__masks")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(of(F.lit(k)).alias(f"n_{k}") for k in KINDS), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
