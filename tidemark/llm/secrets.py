"""Secret scans in whole texts; DataFrame functions only.

Three patterns give base spans. Beside them, long tokens of an encoding's
characters go through a battery of randomness tests over the encoding's
alphabet: chi-squared uniformity, runs above and below its middle, and serial
correlation. Their p-values are combined by Fisher's method: P is the chance
that a random token fits as badly. A token is also judged against structured
text: letters and digits that collide as often as words do make chi-squared
large, the more so the longer the token, and S is the chance of a value as small
as the token's. S / P, 1 at most, is never less than S, so it is a p-value of
structured text too, and each test that speaks against randomness raises it.
Within each band of lengths the Benjamini-Hochberg procedure holds the share of
false discoveries, over a histogram of these p-values, so no sort of all tokens
is needed.

Arrays of a text's matches are worked on in chunks, with sums and ends carried
from chunk to chunk, so that time stays near linear in the matches of a text.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
# Marks of matches: private characters, which stand for "~" where a text has them; no pattern knows the first three.
_A, _B, _C, _M = "\ue000", "\ue001", "\ue002", "\ue003"
ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Base spans count as token characters here, so what touches one is of the same run; such runs are left out.
TOKEN = rf"(?<![A-Za-z0-9+/_={_M}-])[A-Za-z0-9+/_={_M}-]{{20,}}+"
VALUE_LENGTH = 8
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, pattern, alphabet, how often two characters of structured text agree; the first that fits is inferred.
#: English letters of one case agree with chance 0.066; two cases or digits among them lower that; hexadecimal words and
#: numbers use about half of their 16 digits, so twice 1 / 16.
ENCODINGS = (
    ("hex", r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", DIGITS + "abcdef", 0.125),
    ("HEX", r"(?=.*[0-9])(?=.*[A-F])[0-9A-F]+", DIGITS + "ABCDEF", 0.125),
    ("base32", r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*", UPPER + "234567", 0.066),
    ("base64", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*", UPPER + LOWER + DIGITS + "+/", 0.055),
    ("base64url", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*", UPPER + LOWER + DIGITS + "-_", 0.055),
    ("lower32", r"(?=.*[2-7])(?=.*[a-z])[a-z2-7]+=*", LOWER + "234567", 0.066),
    ("lower36", r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+", LOWER + DIGITS, 0.055),
    ("UPPER36", r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+", UPPER + DIGITS, 0.055),
    ("lower", r"[a-z]+", LOWER, 0.066),
    ("UPPER", r"[A-Z]+", UPPER, 0.066),
    ("letters", r"(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+", UPPER + LOWER, 0.055),
)
#: The first of ENCODINGS that words are of, too: they have bands of their own, so that words don't raise the others' bounds.
WORDLIKE = 5
#: Bounds of bands of lengths, false discovery rate, p-value bins, matches of a chunk.
BANDS, RATE, BINS_PER_DECADE, MAX_BIN, CHUNK = (32, 64, 128), 0.01, 50, 4000, 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chunks(items: Column) -> Column:
    n = F.size(items)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda j: F.slice(items, j * CHUNK + 1, F.lit(CHUNK)))


def _carried(each: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """start, then the values of each joined on, one by one: what stands before each, and at the end."""
    return F.aggregate(each, F.array(start), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))


def _marked_spans(text: Column, pattern: str, mark: str, kind: int, value: int = 0, with_text: bool = False) -> Column:
    """Spans (start, kind, end) of matches; value: least length of what stands after the inner mark. With their texts if asked."""
    empty = F.expr(f"cast(array() as array<struct<start:int,kind:int,end:int{',text:string' if with_text else ''}>>)")

    def measured(part: Column) -> Column:
        def of(match: Column) -> Column:
            plain = F.replace(match, F.lit(_C), F.lit(""))
            long = F.length(F.substring_index(match, _C, -1)) >= value
            return F.struct(F.length(plain).alias("size"), (F.length(part) - F.length(match) - 1 + F.length(plain)).alias("width"), long.alias("long"), *([plain.alias("text")] if with_text else []))

        return _let(F.substring_index(part, _B, 1), of)

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["size"]).alias("end"), *([x["text"].alias("text")] if with_text else []))
        return F.struct((acc["at"] + x["width"]).alias("at"), F.when(x["long"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def placed(chunks: Column, first: Column) -> Column:
        widths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["width"]))
        inside = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"]
        before = _carried(widths, first, lambda a, w: a + w)
        return F.flatten(F.filter(F.zip_with(chunks, before, inside), lambda x: x.isNotNull()))

    def found(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), measured)
        return _let(rest, lambda items: _let(_chunks(items), lambda chunks: placed(chunks, F.length(F.get(parts, F.lit(0))))))

    return F.when(text.rlike(pattern), _let(F.split(F.regexp_replace(text, pattern, mark), _A, -1), found)).otherwise(empty)


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with put(place up to which it is done, span) for each of the spans, which are in order and may overlap."""

    def chunk(c: Column, at: Column, last: Column, whole: Column) -> Column:
        def step(region: Column):
            def f(acc: Column, s: Column) -> Column:
                gap = F.substring(region, acc["at"] - at + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, put(acc["at"], s))).alias("out"))

            return f

        start = F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        return _let(F.substring(whole, at + 1, last - at), lambda region: F.array_join(F.aggregate(c, start, step(region))["out"], ""))

    def all_(whole: Column, chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))

        def joined(ats: Column) -> Column:
            pairs = F.zip_with(F.slice(ats, F.lit(1), F.size(ats) - 1), F.slice(ats, F.lit(2), F.size(ats) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            pieces = F.zip_with(chunks, pairs, lambda c, p: chunk(c, p["a"], p["b"], whole))
            return F.concat(F.array_join(pieces, ""), F.substring(whole, F.element_at(ats, -1) + 1, F.length(whole)))

        return _let(_carried(ends, F.lit(0), lambda a, e: F.greatest(a, e)), joined)

    return _let(text, lambda whole: _let(spans, lambda s: F.when(F.size(s) > 0, _let(_chunks(s), lambda chunks: all_(whole, chunks))).otherwise(whole)))


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of a normal variable, by a polynomial good to 1e-7 of the density."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(span: Column) -> Column:
    """start, end, band, bin (of the p-value; -1 where no encoding is inferred)."""
    token, n_all = span["text"], span["end"] - span["start"]
    enc = reduce(lambda a, i: a.when(token.rlike(f"^(?:{ENCODINGS[i][1]})$"), F.lit(i)), range(1, len(ENCODINGS)), F.when(token.rlike(f"^(?:{ENCODINGS[0][1]})$"), F.lit(0)))
    alphabets, agreements = F.array(*(F.lit(e[2]) for e in ENCODINGS)), F.array(*(F.lit(e[3]) for e in ENCODINGS))
    zero = {"n": 0.0, "last": -1.0, "sum": 0.0, "sq": 0.0, "lag": 0.0, "first": 0.0, "high": 0.0, "runs": 0.0}

    def judged(x: Column) -> Column:
        body, alphabet, agree = x["body"], x["alphabet"], x["agree"]
        k = F.length(alphabet).cast("double")
        square = F.aggregate(F.transform(F.split(alphabet, "", -1), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
        codes = F.transform(F.split(body, "", -1), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

        def step(acc: Column, c: Column) -> Column:
            up, was = c >= k / 2, acc["last"] >= k / 2
            return F.struct(
                (acc["n"] + 1).alias("n"), c.alias("last"), (acc["sum"] + c).alias("sum"), (acc["sq"] + c * c).alias("sq"),
                (acc["lag"] + F.when(acc["n"] > 0, acc["last"] * c).otherwise(0.0)).alias("lag"), F.when(acc["n"] > 0, acc["first"]).otherwise(c).alias("first"),
                (acc["high"] + up.cast("double")).alias("high"), (acc["runs"] + ((acc["n"] == 0) | (up != was)).cast("double")).alias("runs"),
            )

        def tests(s: Column, square: Column) -> Column:
            n, mean = s["n"], s["sum"] / s["n"]
            chi = square * k / n - n
            chi_z = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
            expected = 1 + 2 * s["high"] * (n - s["high"]) / n
            runs_var = (expected - 1) * (expected - 2) / (n - 1)
            runs_z = F.when(runs_var > 0, (s["runs"] - expected) / F.sqrt(runs_var)).otherwise(99.0)
            spread = s["sq"] - n * mean * mean
            lagged = s["lag"] - mean * (2 * s["sum"] - s["last"] - s["first"]) + (n - 1) * mean * mean
            serial_z = F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(99.0)
            excess = (n - 1) * (k * agree - 1)
            structured = ((k - 1) + excess - chi) / F.sqrt(2 * ((k - 1) + 2 * excess))
            return F.struct(chi_z.alias("chi"), F.abs(runs_z).alias("runs"), F.abs(serial_z).alias("serial"), structured.alias("structured"))

        def p_bin(z: Column) -> Column:
            least = lambda p: F.greatest(p, F.lit(1e-79))
            half = -(F.log(least(_upper_tail(z["chi"]))) + F.log(least(2 * _upper_tail(z["runs"]))) + F.log(least(2 * _upper_tail(z["serial"]))))
            # of three p-values half of Fisher's statistic is the sum of -ln p; its tail with six degrees of freedom
            random_ = _let(half, lambda h: -h + F.log(1 + h + h * h / 2))
            ratio = F.log(least(_upper_tail(z["structured"]))) - F.least(random_, F.lit(0.0))
            return F.least(F.greatest(F.floor(-ratio / F.log(F.lit(10.0)) * BINS_PER_DECADE), F.lit(0)), F.lit(MAX_BIN)).cast("int")

        sums = F.aggregate(codes, F.struct(*(F.lit(v).alias(c) for c, v in zero.items())), step)
        return _let(F.struct(sums.alias("s"), square.alias("square")), lambda y: _let(tests(y["s"], y["square"]), p_bin))

    def scored(e: Column) -> Column:
        facts = F.struct(F.rtrim(token, F.lit("=")).alias("body"), F.get(alphabets, e).alias("alphabet"), F.get(agreements, e).alias("agree"))
        wordlike = F.when(e >= WORDLIKE, len(BANDS) + 1).otherwise(0)
        band = sum(((n_all >= b).cast("int") for b in BANDS[1:]), (n_all >= BANDS[0]).cast("int")) + wordlike
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), band.alias("band"), F.when(e.isNull(), F.lit(-1)).otherwise(_let(facts, judged)).alias("bin"))

    return _let(enc, scored)


def analysed(rows: DataFrame, text: str) -> DataFrame:
    """Adds base (spans of the patterns) and tokens (candidates with their bins) to rows, which have no columns of these names."""
    clean = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _A + _B + _C + _M, "~~~~")

    def spans(t: Column) -> Column:
        found = (_marked_spans(t, ASSIGN, f"{_A}$1{_C}$2{_B}", 0, VALUE_LENGTH), _marked_spans(t, ACCESS, f"{_A}$0{_B}", 1), _marked_spans(t, HEX, f"{_A}$0{_B}", 2))
        return F.struct(t.alias("text"), F.array_sort(F.concat(*found)).alias("base"))

    def tokens(x: Column) -> Column:
        masked = _replaced(x["text"], x["base"], lambda at, s: F.repeat(F.lit(_M), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))
        free = _let(masked, lambda m: F.filter(_marked_spans(m, TOKEN, f"{_A}$0{_B}", 3, with_text=True), lambda c: ~F.contains(c["text"], F.lit(_M))))
        return F.struct(x["base"].alias("base"), F.transform(free, _battery).alias("tokens"))

    return rows.withColumn("found", _let(_let(clean, spans), tokens)).select("*", "found.base", "found.tokens").drop("found")


@dataclass
class Cuts:
    """The least accepted bin of each band of lengths, those of WORDLIKE encodings after the others."""

    least: dict[int, int]

    def spans(self, base: Column, tokens: Column) -> Column:
        """All spans of an analysed row in order: those of the patterns and the accepted tokens."""
        least = F.array(*(F.lit(self.least.get(b, MAX_BIN + 1)) for b in range(2 * (len(BANDS) + 1))))
        found = F.filter(tokens, lambda t: t["bin"] >= F.get(least, t["band"]))
        return F.array_sort(F.concat(base, F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))))


def false_discovery_cuts(tokens: DataFrame) -> Cuts:
    """tokens: band and bin of every candidate. In a band of m candidates, the least bin b with 10^-b * m <= RATE * those at b or beyond."""
    counts = tokens.groupBy("band", "bin").agg(F.count("*").alias("n"))  # at most bands * MAX_BIN rows
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    passed = counts.withColumn("beyond", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    fits = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("m") <= RATE * F.col("beyond")
    rows = passed.where((F.col("bin") >= 0) & fits).groupBy("band").agg(F.min("bin").alias("bin")).collect()  # a row for each band
    return Cuts({r["band"]: r["bin"] for r in rows})


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cuts(staged: DataFrame) -> Cuts:
    return false_discovery_cuts(staged.select(F.explode("tokens").alias("t")).select("t.band", "t.bin"))


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, all_spans (array of start, kind, end).

    Offsets count code points, ends are exclusive. Null texts count as empty;
    null keys and repeated rows come back as they are. Overlapping spans of
    different patterns all stay; tokens that overlap one of them add nothing.
    Other columns aren't looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    staged = scratch.stage(analysed(rows, "text").drop("text"), "spans")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = staged.withColumn("all_spans", _cuts(staged).spans(F.col("base"), F.col("tokens")))
    return out.select(F.col("id").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("all_spans")).alias("spans"), "all_spans")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of secrets replaced by a mark; overlapping spans get one. Null texts stay null, all other columns stay as they are.

    Rows are staged with what was found in them, so texts are analysed once.
    """
    scratch = common.Scratch(docs.sparkSession, "redacted")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    staged = scratch.stage(analysed(rows, "text").drop("text"), "rows")
    spans = _cuts(staged).spans(F.col("base"), F.col("tokens"))
    body = F.col("row").getField(text)
    put = lambda at, s: F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit(""))
    cut = F.when(body.isNotNull(), _replaced(body, spans, put))
    return staged.select(*((cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
