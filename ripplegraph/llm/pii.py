"""Personal data: base patterns, and what bootstrapped contexts add to them. Built-in functions only.

Base spans (e-mail, IP, card, phone) are found in every whole text. They seed the bootstrap: the words around a
span form lexical patterns, a pattern's score for a kind is the share of its distinct values that are known to be
of that kind, and a value's score is the noisy-or of its confident patterns. Scores pass between the two sides of this
graph until none changes; values that reach KNOWN join the kind (and keep it), count in every pattern of theirs from then on,
and their occurrences outside base spans are added. Scores have three places and only rise, so the rounds end.

What may be added is a word with a digit or an at sign that has five characters at least without the punctuation around it; a name of letters alone is not
added, however sure its contexts are.

Cases: null text counts as empty; a text without hits has an empty list; rows that repeat a doc_id and text get equal
results each; a null doc_id is kept; spans of one kind never overlap; an added span never overlaps a base one; ties at one start go by
KINDS order; other columns are not read. Very long texts are read whole; contexts reach CONTEXT characters from a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Runs are possessive and start at their first character, or where the last hit ended: the
#: same hits, but a long run without a hit is read once instead of once for each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid hit of the kind.
NEEDS = {"email": "[A-Za-z0-9-]@[A-Za-z0-9-]|[._%+]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Words with a digit or an at sign may be identifiers.
TOKEN, TOKEN_NEEDS = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "[0-9@]"
CONTEXT = 64
#: Distinct known values that a pattern needs; scores from which a pattern is confident and a value known.
SUPPORT, CONFIDENT, KNOWN = 3, 0.8, 0.9
#: Hits whose positions are summed in one inner fold.
CHUNK = 256


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def located(text: str, kind: str, pattern: str, needs: str) -> Column:
    """Hits of the pattern in order: array of (start, end, value, left, right); positions in code points, end exclusive.

    The pieces between the hits give the positions: a running sum, in chunks, so that its cost stays linear."""
    hit = f"named_struct('start', s.at + length(pieces[i]), 'end', s.at + length(pieces[i]) + length(hits[i]), 'value', hits[i], 'left', right(pieces[i], {CONTEXT}), 'right', left(pieces[i + 1], {CONTEXT}))"
    none = "cast(array() as array<struct<start:int,end:int,value:string,left:string,right:string>>)"
    inner = f"aggregate(sequence(c * {CHUNK}, least(c * {CHUNK} + {CHUNK}, size(hits)) - 1), named_struct('at', o.at, 'out', {none}), (s, i) -> named_struct('at', s.at + length(pieces[i]) + length(hits[i]), 'out', concat(s.out, array({hit}))))"
    outer = f"aggregate(sequence(0, (size(hits) - 1) div {CHUNK}), named_struct('at', 0, 'all', array({none})), (o, c) -> transform(array({inner}), x -> named_struct('at', x.at, 'all', concat(o.all, array(x.out))))[0], o -> flatten(o.all))"
    # hits and pieces are bound by a transform over one struct: each is computed once.
    bound = outer.replace("pieces", "b.pieces").replace("hits", "b.hits")
    p = _quoted(pattern)
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(needs)} THEN transform(array(named_struct('hits', regexp_extract_all({text}, {p}, 0), 'pieces', split({text}, {p}, -1))), b -> CASE WHEN size(b.hits) = 0 THEN {none} ELSE {bound} END)[0] ELSE {none} END")


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN cast(d as int) WHEN cast(d as int) > 4 THEN cast(d as int) * 2 - 9 ELSE cast(d as int) * 2 END), 0, (a, d) -> a + d) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(coalesce(nullif(ltrim('0', p), ''), '0') as decimal(38,0)) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
# An address part of any length: only short ones are cast.
_VALID["ip"] = "forall(split(x.value, '[.]'), p -> CASE WHEN length(ltrim('0', p)) > 3 THEN false ELSE cast(concat('0', ltrim('0', p)) as int) <= 255 END)"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), base: array of (start, k, end, kind, value, left, right) by start and kind, tokens: words that may be identifiers."""
    df = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    # One array column for each kind, so that no pattern runs twice.
    df = df.select("doc_id", "h", *(located("t", k, PATTERNS[k], NEEDS[k]).alias(k) for k in KINDS), located("t", "token", TOKEN, TOKEN_NEEDS).alias("tokens"))
    found = [F.expr(f"transform(filter({k}, x -> {_VALID[k]}), x -> named_struct('start', x.start, 'k', {i}, 'end', x.end, 'kind', '{k}', 'value', x.value, 'left', x.left, 'right', x.right))") for i, k in enumerate(KINDS)]
    return df.select("doc_id", "h", F.array_sort(F.concat(*found)).alias("base"), "tokens")


def _patterns() -> Column:
    """The patterns of an occurrence: the two words before it; the word before and the word after."""
    before, after = "split(trim(lower(left)), r'\\s+')", "split(trim(lower(right)), r'\\s+')"
    return F.expr(f"filter(array(CASE WHEN size({before}) > 1 THEN concat('two ', array_join(slice({before}, -2, 2), ' ')) END, CASE WHEN element_at({before}, -1) <> '' AND element_at({after}, 1) <> '' THEN concat('both ', element_at({before}, -1), ' ', element_at({after}, 1)) END), p -> p IS NOT NULL)")


def occurrences(found: DataFrame) -> DataFrame:
    """doc_id, h, start, end, value, kind (null: not base), patterns: base spans, and tokens outside of them."""
    base = found.select("doc_id", "h", F.explode("base").alias("x")).select("doc_id", "h", "x.start", "x.end", "x.value", "x.kind", "x.left", "x.right")
    lead = "length(regexp_extract(value, '^[(\\\\[<\"]*', 0))"
    clear = "filter(tokens, t -> NOT exists(base, b -> b.start < t.end AND t.start < b.end))"
    tokens = found.withColumn("tokens", F.expr(f"CASE WHEN size(base) = 0 THEN tokens ELSE {clear} END")).select("doc_id", "h", F.explode("tokens").alias("x")).select("doc_id", "h", "x.*")
    tokens = tokens.withColumn("core", F.regexp_extract("value", r'^[(\[<"]*(.*?)[)\]>".,;:!?]*$', 1)).withColumn("start", F.expr(f"start + {lead}"))
    tokens = tokens.filter(F.length("core") >= 5).select("doc_id", "h", "start", (F.col("start") + F.length("core")).alias("end"), F.col("core").alias("value"), F.lit(None).cast("string").alias("kind"), "left", "right")
    return base.unionByName(tokens).withColumn("value", F.lower("value")).withColumn("patterns", _patterns()).drop("left", "right")


def bootstrap(found: DataFrame) -> DataFrame:
    """value, kind: values that confident patterns make known, base values left out. found: occurrences()."""
    edges = written(found.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    seeds = written(edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "pii-seeds")
    # A pattern needs SUPPORT known values, whether seeds or found: no other can become confident in any round.
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= SUPPORT)
    edges = written(edges.drop("kind").join(sizes, "pattern"), "pii-sizes")
    found, seen = seeds.limit(0), None
    while True:
        scored = edges.join(seeds.unionByName(found), "value").groupBy("pattern", "kind", "values").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"))
        confident = scored.withColumn("p", F.least(F.lit(1.0), F.round(F.col("sum") / F.col("values"), 9))).filter((F.col("n") >= SUPPORT) & (F.col("p") >= CONFIDENT)).select("pattern", "kind", "p")
        # Noisy-or; a product of (1 - p) as a sum of logarithms, a sure pattern as a small remainder.
        reached = edges.join(confident, "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("p"))))), 3).alias("score"))
        reached = reached.filter(F.col("score") >= KNOWN).join(seeds.select("value"), "value", "left_anti")
        both = found.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False)))
        best = both.groupBy("value", "kind").agg(F.max("old").alias("old"), F.max("score").alias("score")).groupBy("value").agg(F.max(F.struct("old", "score", "kind")).alias("best"))
        found = written(best.select("value", "best.kind", "best.score"), "pii-known")
        now = found.agg(F.count(F.lit(1)), F.sum(F.round(F.col("score") * 1000).cast("bigint"))).first()
        if now == seen or not now[0]:
            return found.select("value", "kind")
        seen = now


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans, each an array of (start, k, end, kind) in order; spans holds base's and the added ones."""
    found = written(base_spans(docs, text), "pii-base")
    seen = written(occurrences(found), "pii-seen")
    added = bootstrap(seen)
    new = seen.filter("kind is null").select("doc_id", "h", "start", "end", "value").join(added, "value")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = new.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), F.struct("start", number.alias("k"), "end", "kind").alias("x")).groupBy("id", "g").agg(F.collect_set("x").alias("new"))
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    both = found.join(new, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    return both.select("doc_id", plain.alias("base"), F.array_sort(F.concat(plain, F.coalesce("new", F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)")))).alias("spans"))
