"""Personal data by patterns, and by bootstrapped context, in DataFrame expressions only.

Four kinds have a form of their own: email, ip, card (Luhn) and phone. What they find are the seeds. The
last one, two and three words before a seed are its lexical patterns, and tokens with digits that no
kind covers are candidate instances with patterns of their own. Patterns and instances form a graph that
is scored in rounds: a pattern's confidence is the summed score of its distinct instances over their
number and one more, if at least LEAST_SEEDS of them are seeds; an unseen instance's score is the best
confidence among its patterns. Instances that end at ACCEPT or more are spans of kind ``id`` wherever
they stand. All sums are partial before they are shuffled, and the join of patterns with their confidence
is salted by the instance, so a pattern that a third of all rows share is no hot key.

The work on a text grows with its length: places come from running sums that are taken in blocks of
SCAN, and parts of a text are read from blocks of PART code points, not counted from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table

# The kinds in their order and their forms (possessive, so that long runs take linear time).
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@._+-]{6,}+"
ID = "id"
ROUNDS = 3
LEAST_SEEDS = 3
ACCEPT = 0.8
CONTEXT_CHARS = 60
PART = 256
SCAN = 64
SALTS = 16
#: In the order that spans are sorted by.
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _may_hold(kind: str, text: Column) -> Column:
    return {
        "email": F.instr(text, "@") > 0,
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.instr(text, "+") > 0,
        ID: text.rlike("[0-9]"),
    }[kind]


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda s: _valid(kind, s["value"])


def _as_kind(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    i = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _in_runs(xs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SCAN).cast("int")), lambda i: F.slice(xs, i * SCAN + 1, F.lit(SCAN)))


def _scan(xs: Column, step, zero: Column, levels: int = 2) -> Column:
    """For each element of an int array, ``step`` folded over those before it, from ``zero``.

    A fold that appends copies its array each time, so it only runs over SCAN elements; folds of whole
    runs are scanned in the same way, ``levels`` times.
    """

    def own(run: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(run, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def scanned(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, zero, step))
        starts = own(sums, zero) if levels == 1 else _let(sums, lambda s: _scan(s, step, zero, levels - 1))
        return F.flatten(F.zip_with(runs, starts, own))

    return _let(xs, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(_let(_in_runs(v), scanned)))


def running_sum(xs: Column) -> Column:
    """The sum of the elements before each element."""
    return _scan(xs, lambda a, x: a + x, F.lit(0))


def running_max(xs: Column) -> Column:
    """The greatest of 0 and the elements before each element."""
    return _scan(xs, lambda a, x: F.greatest(a, x), F.lit(0))


def parts_of(text: Column) -> Column:
    """The text in parts of PART code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), 0)


def cut(parts: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` (exclusive) of a text in parts."""
    at = F.floor(begin / PART).cast("int")
    some = F.array_join(F.slice(parts, at + 1, F.floor(end / PART).cast("int") - at + 1), "")
    return F.when(end > begin, F.substring(some, begin - at * PART + 1, end - begin)).otherwise(F.lit(""))


def places(text: Column, form: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches, in code points.

    The parts between the matches and the matches alternate, so their lengths add up to the places.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, form, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"), m.alias("value")))
        return _let(pairs, lambda p: F.zip_with(p, running_sum(F.transform(p, lambda x: x["skip"] + x["size"])), lambda x, at: F.struct((at + x["skip"]).alias("start"), (at + x["skip"] + x["size"]).alias("end"), x["value"].alias("value"))))

    return _let(F.regexp_extract_all(text, F.lit(form), 0), placed)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    lists = []
    for i, kind in enumerate(KINDS):
        good = F.filter(places(text, FORMS[kind]), _validator(kind))
        lists.append(F.when(_may_hold(kind, text), F.transform(good, _as_kind(i))).otherwise(none))
    return F.array_sort(F.concat(*lists))


def _tokens(text: Column, base: Column) -> Column:
    """Digit-bearing tokens that no base span touches.

    Tokens and base spans lie in one list by start. A base span before a token touches it if the
    greatest end so far lies beyond the token's start, one after it if its start lies before the token's end.
    """
    none = F.array().cast(f"array<{SPAN}>")
    trimmed = F.transform(places(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), F.regexp_replace(s["value"], r"[._+@-]++$", "").alias("value")))
    ended = F.transform(trimmed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))
    likely = F.filter(ended, lambda s: (F.length(s["value"]) >= 6) & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 4))
    far = F.lit(2**31 - 1)

    def free(all_spans: Column) -> Column:
        before = running_max(F.transform(all_spans, lambda s: F.when(s["kind"] < len(KINDS), s["end"]).otherwise(0)))
        # the least start behind is the greatest of far - start, taken from the back
        behind = F.reverse(running_max(F.reverse(F.transform(all_spans, lambda s: F.when(s["kind"] < len(KINDS), far - s["start"]).otherwise(0)))))
        known = F.zip_with(all_spans, F.arrays_zip(before.alias("before"), behind.alias("behind")), lambda s, k: F.struct(s.alias("s"), k["before"].alias("before"), (far - k["behind"]).alias("behind")))
        return F.transform(F.filter(known, lambda k: (k["s"]["kind"] == len(KINDS)) & (k["before"] <= k["s"]["start"]) & (k["behind"] >= k["s"]["end"])), lambda k: k["s"])

    kept = _let(likely, lambda t: F.when((F.size(t) == 0) | (F.size(base) == 0), t).otherwise(_let(F.array_sort(F.concat(base, t)), free)))
    return F.when(_may_hold(ID, text), kept).otherwise(none)


def _patterns(parts: Column, start: Column) -> Column:
    """The last one, two and three words before a place, digits made alike; those that exist."""
    before = cut(parts, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start)
    words = F.filter(F.split(F.lower(F.regexp_replace(before, "[0-9]", "0")), r"\s+"), lambda w: w != "")
    return _let(words, lambda w: F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: n <= F.size(w)), lambda n: F.array_join(F.slice(w, F.size(w) - n + 1, n), " ")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT, keep: bool = True) -> DataFrame:
    """row (the input's columns in a struct; without ``keep`` the id alone), doc_id, base and spans (arrays of start, kind, end, value by start and kind) for every row.

    ``base`` are the spans of the four forms, ``spans`` these and the discovered identifiers. Null texts
    are empty and have no span; repeated rows are found alike; a null id stays. Columns of any name may
    come along. An empty table gives no rows.
    """
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("base", base_spans(text))
    rows = rows.withColumn("tokens", _tokens(text, F.col("base"))).withColumn("uid", F.monotonically_increasing_id())
    with_patterns = _let(parts_of(text), lambda p: F.transform(F.concat("base", "tokens"), lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), _patterns(p, s["start"]).alias("patterns"))))
    rows = rows.withColumn("uses", F.when(F.size("base") + F.size("tokens") > 0, with_patterns))
    if not keep:
        rows = rows.withColumn("row", F.struct(F.col("row")[id_col].alias(id_col)))
    rows = through_table(rows, "pii-rows")
    uses = rows.select(F.explode("uses").alias("u")).select(F.col("u.value").alias("value"), (F.col("u.kind") < len(KINDS)).cast("int").alias("seed"), F.explode("u.patterns").alias("pattern"))
    edges = through_table(uses.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        weighed = edges.join(scores, "value")
        confidence = weighed.groupBy("pattern").agg(F.sum("seed").alias("seeds"), (F.sum("score") / (F.count("*") + 1)).alias("confidence")).where(F.col("seeds") >= LEAST_SEEDS).select("pattern", "confidence")
        own = salted.join(confidence.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "salt"], "left").groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score"))
        scores = through_table(own, "pii-scores")
    unseen = scores.join(edges.groupBy("value").agg(F.max("seed").alias("seed")).where("seed = 0").select("value"), "value").where(F.col("score") >= accept).select("value")
    hits = rows.select("uid", F.explode("tokens").alias("t")).join(unseen.withColumnRenamed("value", "_v"), F.lower(F.col("t.value")) == F.col("_v"), "left_semi")
    extra = hits.groupBy("uid").agg(F.collect_list("t").alias("extra"))  # of one row
    rows = rows.select("uid", "row", F.col("row")[id_col].alias("doc_id"), "base", F.size("tokens").alias("n_tokens"))
    plain = rows.where("n_tokens = 0").select("row", "doc_id", "base", F.col("base").alias("spans"))  # the most; they meet no join
    joined = rows.where("n_tokens > 0").join(extra, "uid", "left")
    return plain.unionByName(joined.select("row", "doc_id", "base", F.array_sort(F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra"))).alias("spans")))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*KINDS, ID)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets; null stays null."""
    names = F.array(*(F.lit(f"<{k}>") for k in (*KINDS, ID)))

    def shown(parts: Column, upto: Column) -> Column:
        known = F.zip_with(spans, upto, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
        heads = F.filter(known, lambda s: s["start"] >= s["at"])
        told = F.transform(heads, lambda s: F.concat(cut(parts, s["at"], s["start"]), F.element_at(names, s["kind"] + 1)))
        return F.concat(F.array_join(told, ""), cut(parts, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(parts_of(text), lambda p: _let(running_max(F.transform(spans, lambda s: s["end"])), lambda upto: shown(p, upto))))
