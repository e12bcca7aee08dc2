"""Secrets in texts: fixed shapes, and character Markov models compared by log-likelihood ratio.

Two first-order models over single characters, one of random strings and one of ordinary identifiers,
are counted from labelled samples with DataFrame aggregations. A run of identifier characters is a
span of kind markov when its mean log-likelihood ratio per transition reaches the threshold and it
overlaps no span of a fixed shape. In any other run, what lies outside those spans is searched for parts
that reach the threshold by themselves, as keys in paths do; no such part is shorter than SHORTEST. Shorter runs
are scored as a whole, from LEAST_RUN characters on and where they hold a digit and two letters: of random
keys of 12 letters and digits 88 % are found, of 16 characters 94 %, of 19 96 % (the others lack a digit). The main path is one projection of built-in functions: no shuffle,
no Python. The model is a bounded table of 67 * 67 ratios, put into the plan as a constant.

Null text is empty text; it has no spans. Repeated rows and null ids pass through. Extra columns of
docs are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches, matches_of

#: The shapes that count as secrets by themselves.
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run has SHORTEST characters; one of LEAST_RUN to SHORTEST - 1 is scored too if it stands alone and holds a digit and two letters.
SHORTEST, LEAST_RUN = 20, 12
RUN = (
    f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z][0-9+/_=-]*[A-Za-z])"
    f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},{SHORTEST - 1}}}(?![A-Za-z0-9+/_=-])"
)
THRESHOLD = 0.35
#: Parts of a run: segments between "/" and "=", and stretches of at least LEAST characters, which end where the sum falls by DROP.
SEGMENT = "[A-Za-z0-9+_-]{20,}"
LEAST, DROP, AROUND = 10, 10.0, 64
STEPS = len(ALPHABET)

#: Ordinary words from which sample identifiers are made.
ORDINARY = (
    "account action address after again another answer author before between billing button cache change channel client column command comment "
    "configuration connection container content context controller counter country current database default department description destination "
    "development different direction directory document element endpoint environment error event example exception execution expression extension "
    "factory feature field filter folder format function generation getting government handler header history identifier implementation index "
    "information instance interface international language length library listener location manager management measure message method migration "
    "minimum module monitor nothing number object operation option order output package parameter parent partition password pattern performance "
    "permission position previous process product profile project property provider quality question reader reason record reference register "
    "relation report repository request resource response result return schedule scheme second section security sentence server service session "
    "setting shipping signature something source standard statement station status storage string structure subject support system table target "
    "template territory thread through ticket together total transaction transfer transport understanding update upload validation value variable "
    "version visible warning weather window without worker writer"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, secret) of n made strings of each kind; fixed by n, so that every run trains the same model."""
    words = F.split(F.lit(" ".join(ORDINARY)), " ")

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))

    joined = {
        0: F.concat(word(1), F.lit("_"), word(2), F.lit("_"), word(3)),
        1: F.concat(word(1), F.initcap(word(2)), F.initcap(word(3))),
        2: F.concat(word(1), F.lit("/"), word(2), F.lit("-"), word(3)),
        3: F.concat(F.upper(word(1)), F.lit("_"), F.upper(word(2))),
        4: F.concat(word(1), word(2), F.pmod("id", F.lit(100)).cast("string")),
        5: F.concat(word(1), word(2), word(3)),
    }
    raw = F.sha2(F.concat(F.lit("s"), F.col("id")).cast("binary"), 512)
    random = {0: F.base64(F.unhex(raw)), 1: raw, 2: F.upper(raw), 3: F.conv(F.substring(raw, 1, 15), 16, 36), 4: F.translate(F.base64(F.unhex(raw)), "+/=", "-_"), 5: F.base64(F.unhex(raw))}

    def pick(of: dict[int, Column]) -> Column:
        out = of[0]
        for k, c in list(of.items())[1:]:
            out = F.when(F.pmod("id", F.lit(6)) == k, c).otherwise(out)
        return out

    ids = spark.range(n)
    return ids.select(pick(joined).alias("text"), F.lit(False).alias("secret")).unionByName(ids.select(pick(random).alias("text"), F.lit(True).alias("secret")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by transition, row-major over ALPHABET; from labelled (text, secret) rows.

    Transitions are counted on the executors with smoothing 0.5; at most 2 * 67 * 67 counts come back.
    """
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = samples.select("secret", codes.alias("c")).select("secret", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("p"))
    counts = {(r.secret, r.a, r.b): r.n for r in pairs.groupBy("secret", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a > 0 and b > 0").collect()}
    rows = {}
    for (secret, a, _), n in counts.items():
        rows[secret, a] = rows.get((secret, a), 0) + n

    def log(secret: bool, a: int, b: int) -> float:
        return math.log((counts.get((secret, a, b), 0) + 0.5) / (rows.get((secret, a), 0) + 0.5 * STEPS))

    return [round(log(True, a, b) - log(False, a, b), 3) for a in range(1, STEPS + 1) for b in range(1, STEPS + 1)]


def ratio(run: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per transition of a run of characters in ALPHABET."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("t")),
        lambda acc, c: F.struct(c.alias("p"), F.when((acc["p"] > 0) & (c > 0), acc["t"] + F.element_at(model, (acc["p"] - 1) * STEPS + c)).otherwise(acc["t"]).alias("t")),
    )
    return total["t"] / F.greatest(F.length(run) - 1, F.lit(1))


def stretches(run: Column, model: Column, threshold: float) -> Column:
    """array<struct<s, e>>: stretches of a run where ratio minus threshold adds up to most, in order.

    A sum starts anew where it is not above 0 or DROP below its maximum; its stretch ends at the maximum.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def steps(c: Column) -> Column:
        n = F.size(c) - 1
        return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.when((a > 0) & (b > 0), F.element_at(model, (a - 1) * STEPS + b) - threshold).otherwise(-1e9))

    def ended(acc: Column) -> Column:
        return F.when(acc["e"] - acc["s"] >= LEAST, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        i, t = acc["i"] + 1, acc["t"] + x
        over = (t <= 0) | (t <= acc["top"] - DROP)
        return F.struct(
            i.alias("i"),
            F.when(over, i).otherwise(acc["s"]).alias("s"),
            F.when(over, i).when(t > acc["top"], i + 1).otherwise(acc["e"]).alias("e"),
            F.when(over, 0.0).otherwise(t).alias("t"),
            F.when(over, 0.0).otherwise(F.greatest(t, acc["top"])).alias("top"),
            F.when(over, ended(acc)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("t"), F.lit(0.0).alias("top"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(F.element_at(F.transform(F.array(codes), steps), 1), start, step, ended)


def merged(spans: Column) -> Column:
    """Spans by s, overlapping ones as one."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (last(acc)["e"] > x["s"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def parts(run: Column, model: Column, threshold: float) -> Column:
    """array<struct<s, e>> of the parts of a run, SHORTEST or longer, whose mean ratio reaches the threshold.

    A stretch is taken with the rest of the segments it begins and ends in if that reaches the threshold too.
    """

    def reaches(s: Column, e: Column) -> Column:
        return (e - s >= SHORTEST) & (ratio(F.substring(run, s + 1, e - s), model) >= threshold)

    def length(text: Column, regex: str) -> Column:
        return F.length(F.regexp_extract(text, regex, 0))

    segments = F.filter(matches(run, F.lit(SEGMENT)), lambda x: x.isNotNull() & reaches(x["s"], x["e"]))
    wide = F.transform(
        stretches(run, model, threshold),
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            (x["s"] - length(F.substring(run, F.greatest(x["s"] - AROUND, F.lit(0)) + 1, F.least(x["s"], F.lit(AROUND))), "[A-Za-z0-9+]*$")).alias("a"),
            (x["e"] + length(F.substring(run, x["e"] + 1, F.lit(AROUND)), "^[A-Za-z0-9+]*")).alias("b"),
        ),
    )
    wide = F.transform(wide, lambda x: x.withField("a", x["a"] + length(F.substring(run, x["a"] + 1, x["b"] - x["a"]), "^[/=]*")).withField("b", x["b"] - length(F.substring(run, x["a"] + 1, x["b"] - x["a"]), "/*$")))
    taken = F.transform(
        wide,
        lambda x: F.when(reaches(x["a"], x["b"]), F.struct(x["a"].alias("s"), x["b"].alias("e"))).when(x["e"] - x["s"] >= SHORTEST, F.struct(x["s"].alias("s"), x["e"].alias("e"))),
    )
    return merged(F.concat(segments, F.filter(taken, lambda x: x.isNotNull())))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, spans array<struct<s, k, e>>) of all rows, by s, then kind as in KINDS, then e.

    k is the place of the kind in KINDS. Positions are in code points, end exclusive.
    """
    return found(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model, threshold)


def found(t: DataFrame, model: list[float], threshold: float) -> DataFrame:
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    assign = F.filter(matches(F.col("text"), F.lit(ASSIGN)), lambda x: x.isNotNull())
    assign = F.zip_with(assign, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda x, v: F.when(F.length(v) >= 6, x))
    none = F.array().cast("array<struct<s:int,e:int>>")
    t = t.select(
        "doc_id",
        "text",
        F.when(F.col("text").rlike(ASSIGN), F.filter(assign, lambda x: x.isNotNull())).otherwise(none).alias("assign"),
        matches_of(F.col("text"), ACCESS, F.col("text").rlike(ACCESS)).alias("access"),
        matches_of(F.col("text"), HEX, F.col("text").rlike(HEX)).alias("hex"),
        matches_of(F.col("text"), RUN, F.col("text").rlike(RUN)).alias("run"),
    )
    base = F.concat("assign", "access", "hex")

    def inside(r: Column) -> Column:
        return F.filter(base, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"]))

    def outside(r: Column) -> Column:
        """The run, with dots in place of spans of fixed shapes."""
        return F.aggregate(
            F.transform(inside(r), lambda b: F.struct(F.greatest(b["s"], r["s"]).alias("s"), F.least(b["e"], r["e"]).alias("e"))),
            F.substring("text", r["s"] + 1, r["e"] - r["s"]),
            lambda acc, b: F.overlay(acc, F.repeat(F.lit("."), b["e"] - b["s"]), b["s"] - r["s"] + 1, b["e"] - b["s"]),
        )

    def likely(r: Column) -> Column:
        whole = (F.size(inside(r)) == 0) & (ratio(F.substring("text", r["s"] + 1, r["e"] - r["s"]), table) >= threshold)
        of = F.flatten(F.transform(F.array(outside(r)), lambda run: parts(run, table, threshold)))
        return F.when(whole, F.array(r)).otherwise(F.transform(of, lambda x: F.struct((r["s"] + x["s"]).alias("s"), (r["s"] + x["e"]).alias("e"))))

    markov = F.flatten(F.transform("run", likely))

    def kind(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    every = F.concat(kind(F.col("assign"), 0), kind(F.col("access"), 1), kind(F.col("hex"), 2), kind(markov, 3))
    return t.select("doc_id", "text", F.array_sort(every).alias("spans"))


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """All rows with all their columns, every span of the text replaced by the mark; n_chars, if there, counts anew."""
    t = docs.select(F.struct(*docs.columns).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = found(t, model, threshold)
    some = F.size("spans") > 0
    new = {"text": redacted(F.col("text"), F.col("spans"), mark)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return t.select(*[F.when(some, new[c]).otherwise(F.col("doc_id")[c]).alias(c) if c in new else F.col("doc_id")[c].alias(c) for c in docs.columns])


def said(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(
        spans,
        start,
        lambda acc, x: F.when(
            x["s"] >= acc["at"],
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))
