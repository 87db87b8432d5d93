"""Secret scans with a randomness test battery (native: SQL functions only).

Three fixed patterns give base spans. The battery adds spans: a token of an
inferred encoding (hex, base32, base36, base62, base64) is tested for uniform
use of its alphabet (Pearson's chi-squared, standardised with the exact mean and
variance for its length), for the number of runs about the alphabet's middle
(Wald and Wolfowitz) and for serial correlation at lag 1. The three p-values are
combined by Fisher's method. Benjamini-Hochberg control within strata of
encoding and length then decides which tokens are *not* random; tokens that stay
and carry enough bits for the battery to tell them from prose are secrets.

The hypothesis that is rejected is randomness, so the control bounds the share of
random tokens among those let go (lost secrets), not that of false alarms. Tokens
of one case of letters, capitalised words and tokens without a digit count as
words and are not tested.

The p-values of a stratum are counted in a fixed histogram of -log10 p, so the
control sees every token of the corpus through a table of bounded size.

Edge cases: a null text counts as empty; an empty table gives an empty result;
texts without a match get empty spans; rows that repeat an id are scanned each
by itself; positions are code points; an input column named like one that
``scan`` adds (ADDED) gives way to it, other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import likely, materialised, table, text_or_empty

# The base patterns of the contract, and the length that a match must have.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ADDED = (*[f"n_{k}" for k in KINDS[:3]], "base", "spans")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MIN_BITS = 90.0
FDR = 0.05
BINS_PER_DECADE, MAX_DECADES = 20, 20
# name, pattern that the whole token matches, alphabet in the order of its codes
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array<struct<start, stop, token>>, in code points.

    The gaps between matches come from splitting by the same pattern.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,token:string>>)").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["token"])
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"), pair["token"].alias("token")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("token"))
    return F.when(F.size(found) == 0, F.expr("cast(array() as array<struct<start:int,stop:int,token:string>>)")).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def _spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["stop"].alias("stop")))


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex and base (array<struct<start, kind, stop>> in order).

    A hex run under 24 characters never counts, so only long runs are looked
    for; the other two patterns are matched as they stand and then filtered.
    """
    value = lambda m: F.length(F.regexp_extract(m["token"], ASSIGN, 1))
    df = df.withColumn("__assign", F.filter(matches(F.col(text), ASSIGN), lambda m: value(m) >= 6))
    df = df.withColumn("__access", F.filter(matches(F.col(text), ACCESS), lambda m: m["stop"] - m["start"] >= 20))
    df = df.withColumn("__hex", matches(F.col(text), HEX[:-1] + "{24,}"))
    base = F.array_sort(F.concat(_spans(F.col("__assign"), "assign"), _spans(F.col("__access"), "access"), _spans(F.col("__hex"), "hex")))
    counts = {f"n_{k}": F.size(f"__{k}").cast("long") for k in KINDS[:3]}
    return df.withColumns(counts | {"base": base}).drop("__assign", "__access", "__hex")


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def with_battery(tokens: DataFrame) -> DataFrame:
    """tokens has a column ``token``; adds encoding, n, p_uniform, p_runs, p_serial and p (Fisher).

    ``encoding`` is null for plain words: letters of one case, or a capital and small letters.
    """
    tok = F.col("token")
    word = tok.rlike("^[A-Z]?[a-z]+$") | tok.rlike("^[A-Z]+$") | tok.rlike("^[0-9]+$") | ~tok.rlike("[0-9]")
    encoding = reduce(lambda rest, e: F.when(tok.rlike(e[1]), F.lit(e[0])).otherwise(rest), reversed(ENCODINGS), F.lit(None).cast("string"))
    size = reduce(lambda rest, e: F.when(F.col("encoding") == e[0], F.lit(float(len(e[2])))).otherwise(rest), ENCODINGS, F.lit(None).cast("double"))
    alphabet = reduce(lambda rest, e: F.when(F.col("encoding") == e[0], F.lit(e[2])).otherwise(rest), ENCODINGS, F.lit(""))
    shown = F.when(F.col("encoding") == "hex", F.lower("token")).otherwise(F.translate("token", "_-", "/+"))
    df = tokens.withColumn("encoding", F.when(~word, encoding)).filter(F.col("encoding").isNotNull())
    df = df.withColumns({"a": size, "__alphabet": alphabet, "n": F.length("token").cast("double")})
    df = df.withColumn("codes", F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c: F.position(c, F.col("__alphabet")).cast("double") - 1))
    ones = F.aggregate(F.map_values(F.expr("aggregate(codes, cast(map() as map<double,int>), (m, x) -> map_concat(map_filter(m, (k, v) -> k != x), map(x, coalesce(m[x], 0) + 1)))")), F.lit(0.0), lambda s, x: s + x * x)
    df = df.withColumn("chi2", F.col("a") / F.col("n") * ones - F.col("n"))
    df = df.withColumn("p_uniform", normal_tail((F.col("chi2") - (F.col("a") - 1)) / F.sqrt(2 * (F.col("a") - 1) * (F.col("n") - 1) / F.col("n"))))
    df = df.withColumn("high", F.transform("codes", lambda c: (c >= F.col("a") / 2).cast("int")))
    pairs = lambda left, right, f: F.zip_with(F.expr(f"slice({left}, 1, size({left}) - 1)"), F.expr(f"slice({right}, 2, size({right}) - 1)"), f)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumns({"runs": 1 + total(pairs("high", "high", lambda x, y: (x != y).cast("double"))), "n1": total("high"), "mean": total("codes") / F.col("n")})
    n, n1, n2 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    expected, product = 1 + 2 * n1 * n2 / n, 2 * n1 * n2
    spread = product * (product - n) / (n * n * (n - 1))
    df = df.withColumn("p_runs", F.when(spread > 0, 2 * normal_tail(F.abs(F.col("runs") - expected) / F.sqrt(F.when(spread > 0, spread)))).otherwise(F.lit(1e-9)))
    dev = lambda x: x - F.col("mean")
    around = total(F.transform("codes", lambda x: dev(x) * dev(x)))
    serial = total(pairs("codes", "codes", lambda x, y: dev(x) * dev(y)))
    df = df.withColumns({"__ss": around, "__sc": serial})
    r = F.col("__sc") / F.when(F.col("__ss") > 0, F.col("__ss"))
    df = df.withColumn("p_serial", F.coalesce(2 * normal_tail(F.abs((r + 1 / n) * F.sqrt(n))), F.lit(1e-9)))
    safe = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0))
    half = -(F.log(safe("p_uniform")) + F.log(safe("p_runs")) + F.log(safe("p_serial")))
    df = df.withColumn("__half", half).withColumn("p", F.exp(-F.col("__half")) * (1 + F.col("__half") + F.col("__half") * F.col("__half") / 2))
    return df.drop("__alphabet", "codes", "high", "__half", "__ss", "__sc")


def with_strata(tested: DataFrame) -> DataFrame:
    """Adds bits, stratum (encoding and octave of length) and bin of -log10 p."""
    digits = F.least(-F.log10(F.greatest("p", F.lit(1e-300))), F.lit(float(MAX_DECADES)))
    return tested.withColumns({
        "bits": F.col("n") * F.log2("a"), "bin": F.floor(F.greatest(digits, F.lit(0.0)) * BINS_PER_DECADE).cast("int"),
        "stratum": F.concat_ws(":", "encoding", F.least(F.floor(F.log2("n")), F.lit(10)).cast("string")),
    })


def rejection_bins(strata: DataFrame, level: float = FDR) -> DataFrame:
    """Per stratum the least bin that Benjamini-Hochberg rejects as not random. At most strata x bins rows."""
    counts = strata.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    counts = counts.withColumns({"above": F.sum("k").over(down), "all": F.sum("k").over(Window.partitionBy("stratum"))})
    largest = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return counts.filter(largest <= level * F.col("above") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("reject_from"))


def random_spans(texts: DataFrame, level: float = FDR, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, row key and array of spans of the tokens that the battery holds for secrets.

    Tokens are few against the text, and only they are shuffled.
    """
    strata = with_strata(with_battery(texts.filter(F.size("tokens") > 0).select("row", F.inline("tokens"))))
    cut = rejection_bins(strata, level)
    kept = strata.join(F.broadcast(cut), "stratum", "left").filter((F.col("bits") >= min_bits) & (F.col("reject_from").isNull() | (F.col("bin") < F.col("reject_from"))))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "stop"))).alias("random"))


def _shown(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, level: float = FDR, min_bits: float = MIN_BITS) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base and spans (arrays of start, kind, stop), one row per input row.

    Rows are keyed by a hash of id and text: rows that agree in both have the same spans. A first pass reads tokens
    alone, and those of secrets are a small written table; the second matches the base patterns. Only rows whose key may be
    in that table are shuffled to join it. A random token inside a base span adds nothing.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    docs = docs.withColumn("__text", text_or_empty()).withColumn("__row", F.xxhash64("doc_id", "__text"))
    small = docs.select(F.col("__row").alias("row"), matches(F.col("__text"), TOKEN).alias("tokens")).filter(F.size("tokens") > 0)
    extra = materialised(random_spans(small.groupBy("row").agg(F.first("tokens").alias("tokens")), level, min_bits))
    named = extra.select(F.col("row").alias("__key"), F.col("random").alias("__random"))
    asked = likely(docs, named, "__row", key="__key").join(named, F.col("__row") == F.col("__key"), "left").drop("__key")
    others = likely(docs, named, "__row", key="__key", inverse=True).withColumn("__random", F.lit(None).cast(extra.schema["random"].dataType))
    joined = with_base_spans(asked.unionByName(others), "__text").drop("__row", "__text")
    outside = lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["stop"] <= b["stop"]))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(F.filter("__random", outside), none)))).drop("__random")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        ahead = s["start"] >= state["at"]
        out = F.when(ahead, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    folded = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
