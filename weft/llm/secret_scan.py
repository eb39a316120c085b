"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Everything runs in DataFrame functions. The model is a table of the
log-likelihood ratio of each character pair, counted from labelled samples; a
long token is a secret if its mean ratio is above a threshold.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import bound

# The kinds of the base scan in their order, each with its
# pattern, the group whose length counts, and that length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Kind of the spans that the model adds, and the tokens it judges.
KIND, TOKEN, TOKEN_LENGTH = "markov", r"[A-Za-z0-9+/_=-]{20,}", 20
#: Characters of the models.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats by which the random model must beat the other, for each character pair.
THRESHOLD = 0.5
#: Labelled tokens of either kind that the models are fitted on.
SAMPLES = 4096

# Parts that the samples of ordinary identifiers are made of: any list of common words would do.
PARTS = (
    "account address alpha answer array batch before block branch buffer build cache call change channel check child "
    "class client column config connect content context control copy count create current data date default delete "
    "description device different document element employment entry environment error event example experience export "
    "field file filter first folder format frame function general government group handler header height history host "
    "image important index information input insert international interval item key label language length letter level "
    "library line link list load local lock management manager map matrix member message method model module name network "
    "node number object offset operation option order other output package page parent parse part path pattern people "
    "place point pointer policy position prefix process product program property query queue random range read record "
    "region register remove render report request resource response result return river role root row sample scale schedule "
    "schema search section segment select sequence server service session shape signal size sort source space stage start "
    "state static status step stop storage stream string style system table target task template text thread through time "
    "token total trace transaction transform tree type understanding update upload user value vector version view visit "
    "water width window without word work worker world write"
).split()


def labelled_samples(spark, samples: int = SAMPLES, first: int = 0) -> DataFrame:
    """token string, is_random boolean: random strings and identifiers made by rule, numbered from first.

    Random strings are hex digits, base64 and upper-case letters with digits
    from a hash of the row number. Identifiers join parts by underscores,
    hyphens, slashes, nothing, or capital letters; rules of one character and
    times stand for what else is long and ordinary.
    """
    i = F.col("id")
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = lambda salt: F.element_at(parts, (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    words = F.array(pick(1), pick(2), pick(3), pick(4))
    capital = F.transform(words, lambda w: F.initcap(w))
    joined = lambda by: F.array_join(words, by)
    identifier = reduce(
        lambda rest, n: F.when(i % 8 == n[0], n[1]).otherwise(rest),
        [
            (1, joined("-")), (2, joined("/")), (3, joined("")), (4, F.array_join(capital, "")), (5, F.upper(joined("_"))),
            (6, F.repeat(F.substr(F.lit(CHARACTERS), F.pmod(i / 8, F.lit(len(CHARACTERS))).cast("int") + 1, F.lit(1)), 40)),
            (7, F.date_format((i * 86_399_999).cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss")),
        ],
        joined("_"),
    )
    digest = F.sha2(i.cast("string"), 256)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    upper = F.translate(F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[+/=]", ""), 1, 40)), "-", "")
    random = F.when(i % 3 == 0, digest).when(i % 3 == 1, base64).otherwise(upper)
    ids = spark.range(first, first + samples)
    return ids.select(random.alias("token"), F.lit(True).alias("is_random")).unionByName(
        ids.select(identifier.alias("token"), F.lit(False).alias("is_random"))
    )


def train_model(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair (first, second), in the order of CHARACTERS.

    labelled has token and is_random; pairs with other characters, null tokens
    and null labels count for nothing. Every pair has half a count more, so an
    unseen one is judged as if between the models. The driver gets one number
    for each pair of characters at most.
    """
    size = len(CHARACTERS)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda n: F.col("token").substr(n, F.lit(2))))
    pairs = labelled.where((F.length("token") > 1) & F.col("is_random").isNotNull()).select("is_random", pair.alias("pair"))
    counts = {True: [0.5] * size**2, False: [0.5] * size**2}
    for row in pairs.where(pairs.pair.rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("is_random", "pair").count().collect():
        a, b = map(CHARACTERS.index, row.pair)
        counts[row.is_random][a * size + b] += row["count"]
    import math

    def log_probabilities(table):
        sums = [sum(table[a * size : (a + 1) * size]) for a in range(size)]
        return [math.log(x / sums[i // size]) for i, x in enumerate(table)]

    return [round(r - s, 4) for r, s in zip(log_probabilities(counts[True]), log_probabilities(counts[False]), strict=True)]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(CHARACTERS), c)))
    ratio = lambda before, code: F.element_at(table, (before - 1) * len(CHARACTERS) + code)
    total = F.aggregate(
        F.filter(codes, lambda c: c > 0),
        F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")),
        lambda s, code: F.struct(
            code.alias("before"), (s["sum"] + F.when(s["before"] > 0, ratio(s["before"], code)).otherwise(0.0)).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return total / (F.length(token) - 1)


def running(items: Column, first: Column, kind: str, step) -> Column:
    """The states of a fold over items, one for each: array<kind>, where step(state, item) gives the next state.

    An array that grows by one is copied for each item, so items are taken in
    chunks of about the square root of their number: n items take n^1.5 copies.
    """

    def state(last: Column, states: Column) -> Column:
        return F.struct(last.alias("last"), states.alias("states"))

    def chunk(before: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            state(before, F.array().cast(f"array<{kind}>")),
            lambda held, item: bound(step(held["last"], item), lambda s: state(s, F.concat(held["states"], F.array(s)))),
        )

    def chunks(all_: Column, width: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(all_, at, width))

    width = lambda all_: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_)))).cast("int")
    whole = F.aggregate(
        bound(items, lambda all_: bound(width(all_), lambda w: chunks(all_, w))),
        state(first, F.array().cast(f"array<array<{kind}>>")),
        lambda held, part: bound(
            chunk(held["last"], part), lambda c: state(c["last"], F.concat(held["states"], F.array(c["states"])))
        ),
    )
    return F.flatten(whole["states"])


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, keep) -> Column:
    """array<struct<start, kind order, end, kind, token>> of matches, in code points.

    Matches lie between the pieces that the pattern splits a text in, so that
    their places are running sums of lengths.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string,token:string>>")
    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), judged.alias("judged"))
    places = bound(
        matches,
        lambda all_: F.arrays_zip(
            running(
                F.transform(all_, lambda m: F.length(m["gap"]) + F.length(m["match"])), F.lit(0), "int", lambda end, size: end + size
            ).alias("end"),
            F.transform(all_, lambda m: F.length(m["match"])).alias("size"),
            F.transform(all_, lambda m: m["judged"]).alias("token"),
        ),
    )
    spans = F.transform(
        F.filter(places, lambda m: keep(m["token"])),
        lambda m: F.struct(
            (m["end"] - m["size"]).alias("start"), F.lit(order).alias("kind_order"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), m["token"].alias("token"),
        ),
    )
    return F.when(text.rlike(pattern), spans).otherwise(none)


def without_overlap(added: Column, base: Column) -> Column:
    """The spans of added that overlap none of base, in order.

    In order of their starts, a span overlaps one of base before it if the
    largest end so far is behind its start, and one after it if the smallest
    start from behind is before its end.
    """
    marked = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("new"), s.alias("span"))),
        F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("new"), s.alias("span"))),
    )
    # Spans that start together lie side by side, those of base first.
    in_order = F.array_sort(F.transform(marked, lambda m: F.struct(m["start"], m["new"].alias("new"), m["end"], m["span"])))

    def free(ordered: Column) -> Column:
        reached = running(ordered, F.lit(0), "int", lambda end, m: F.when(m["new"], end).otherwise(F.greatest(end, m["end"])))
        far = F.lit(2**31 - 1)
        ahead = running(F.reverse(ordered), far, "int", lambda start, m: F.when(m["new"], start).otherwise(F.least(start, m["start"])))
        judged = F.arrays_zip(ordered.alias("m"), reached.alias("reached"), F.reverse(ahead).alias("ahead"))
        return F.filter(judged, lambda x: x["m"]["new"] & (x["reached"] <= x["m"]["start"]) & (x["ahead"] >= x["m"]["end"]))

    return F.transform(bound(in_order, free), lambda x: x["m"]["span"])


def secret_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> tuple[dict[str, Column], Column]:
    """Columns of the base spans of each kind, and of the spans that the model adds.

    A run of the hex kind counts with 16 digits, so shorter runs are not looked
    at; the same holds for access ids. Added spans overlap no base span.
    """
    base = {}
    for order, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "hex":
            pattern = f"[0-9a-f]{{{least},}}"
        elif kind == "access":
            pattern = f"AKIA[A-Z0-9]{{{least - 4},}}"
        base[kind] = _spans(text, kind, order, pattern, group, lambda token, least=least: F.length(token) >= least)
    added = _spans(text, KIND, len(BASE), TOKEN, 0, lambda token: mean_ratio(token, model) > threshold)
    return base, added


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, and n_markov.

    spans lists kind:start:end of the base spans and of those that the model
    adds, by start, then by kind; ends are exclusive and places are code
    points of the whole text. A null text is empty, however long a text is it
    stays in one row. Rows that repeat are scanned each, also those without a
    doc_id; other columns of docs are ignored; an empty table gives an
    empty result.
    """
    model = model or train_model(labelled_samples(docs.sparkSession))
    text = F.col("__text")
    base, added = secret_spans(text, model, threshold)
    scanned = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).select(
        "doc_id", *[spans.alias(f"__{kind}") for kind, spans in base.items()], added.alias("__added")
    )
    scanned = scanned.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{kind}") for kind in base])))
    free = without_overlap(F.col("__added"), F.col("__base"))
    scanned = scanned.withColumn("__added", F.when(F.size("__added") > 0, free).otherwise(F.col("__added")))
    return scanned.select(
        "doc_id",
        *[F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(_digest(F.col("__base")), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("__base", "__added"))).alias("spans"),
        F.size("__added").cast("long").alias(f"n_{KIND}"),
    )
