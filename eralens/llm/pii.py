"""Personal data by weak supervision, in DataFrame operations only.

Regular expressions propose spans: base ones, which always stay, and weaker ones. Labelers
(the base rule, shape and checksum, gazetteers, words before the span, its neighbours) vote
on each for, against or not at all. Expectation-maximisation over the counts of vote
patterns (at most 3^5) estimates how far each labeler can be trusted and gives every span a
probability. These soft labels train the span classifier, a naive Bayes model over shape,
surroundings and length; a weak span is added if it says so and no base span overlaps it.

Places are code points, ends exclusive. A null text is empty. Proposals of a text are
numbered rows; sums over them give the places, so nothing grows with the square of their
number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralens.llm.common import fresh, stage

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base rules. Possessive where nothing can be given back, and started
# only where a run starts or the last match ended, so that long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Weaker forms: spelled-out mail addresses and phone numbers without a country code.
WEAK = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
# Gazetteers: common ends of domains, first digits of card issuers, networks that name no one.
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|ch|at|nl|us|ca)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
NOBODY = r"^(?:0|127|255|22[4-9]|23[0-9])\."
BEFORE = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\W*$", "ip": r"(?i)\b(?:ip|address|host|server|adresse)\W*$",
          "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W*(?:no|number|nr)?\W*$", "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon)\W*$"}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|serial|build|doi|figure|section|v)\W*$"
LABELERS = ("rule", "shape", "gazetteer", "words", "edges")
SHAPES = 256               # hashed shapes
ROUNDS = 40
CONTEXT = 40


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def proposals(text: Column, pattern: str, kind: str, weak: bool) -> Column:
    """Matches with the length of the gap before each, and what stands around it."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    item = lambda g, h: F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.struct(
        F.lit(kind).alias("kind"), F.lit(weak).alias("weak"), i.alias("i"), F.char_length(F.get(g, i)).alias("gap"), F.get(h, i).alias("value"),
        F.right(F.get(g, i), F.lit(CONTEXT)).alias("left"), F.substring(F.get(g, i + 1), 1, 1).alias("right")))
    found = let(gaps, lambda g: let(hits, lambda h: item(g, h)))
    empty = F.array().cast("array<struct<kind:string,weak:boolean,i:int,gap:int,value:string,left:string,right:string>>")
    sign = {"email": "@", "phone": "+", "ip": "."}.get(kind) if not weak else {"email": "at"}.get(kind)
    may = F.regexp_like(text, F.lit(pattern))
    return F.when((F.contains(text, F.lit(sign)) & may) if sign else may, found).otherwise(empty)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stored table of ``row, doc_id, text_key, found``; it holds no texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = [proposals(text, p, k, weak) for weak, group in ((False, BASE), (True, WEAK)) for k, p in group.items()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), F.concat(*every).alias("found")), "pii-proposals")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_rule(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern is one: address parts up to 255, 16 to 19 digits
    with a right check digit, 8 to 15 digits."""
    small = lambda p: F.regexp_like(p, F.lit("^0*[0-9]{1,3}$")) & (F.right(p, F.lit(3)).cast("int") <= 255)
    n = F.length(digits(value))
    return (F.when(kind == "email", True).when(kind == "ip", F.forall(F.split(value, r"\."), small))
            .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits(value))).otherwise(n.between(8, 15)))


def voted(seen: DataFrame) -> DataFrame:
    """One row per proposal with its place, votes and features."""
    run = Window.partitionBy("row", "kind", "weak").orderBy("i")
    each = seen.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("length", F.char_length("value"))
    each = each.withColumn("stop", F.sum(F.col("gap") + F.col("length")).over(run)).withColumn("start", F.col("stop") - F.col("length"))
    kind, value = F.col("kind"), F.col("value")
    # long or short runs of digits that are no card in the first place
    each = each.where((kind != "card") | F.length(digits(value)).between(13, 19))
    valid = base_rule(kind, value) & ~F.col("weak")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    by_kind = lambda exprs: F.coalesce(*[F.when(kind == k, e) for k, e in exprs.items()])
    n = F.length(digits(value))
    shape = by_kind({"email": vote(F.regexp_like(value, F.lit(r"\.[A-Za-z]{2,}$")), F.lit(True)), "ip": vote(base_rule(kind, value), F.lit(True)),
                     "card": vote(F.call_function("luhn_check", digits(value)), F.lit(True)), "phone": vote(n.between(10, 13), ~n.between(8, 15))})
    gazetteer = by_kind({"email": vote(F.regexp_like(value, F.lit(DOMAINS)), F.lit(False)), "ip": vote(F.lit(False), F.regexp_like(value, F.lit(NOBODY))),
                         "card": vote(F.regexp_like(digits(value), F.lit(ISSUERS)), F.lit(True)), "phone": vote(F.regexp_like(value, F.lit(r"^\+(?:1|33|34|44|49)\b")), F.lit(False))})
    words = vote(by_kind({k: F.regexp_like("left", F.lit(p)) for k, p in BEFORE.items()}), F.regexp_like("left", F.lit(AGAINST)))
    last = F.right("left", F.lit(1))
    glued = F.regexp_like(last, F.lit(r"[\p{L}0-9_/.]")) | F.regexp_like("right", F.lit(r"[\p{L}0-9_/]"))
    around = lambda c: F.when(c == "", "end").when(F.regexp_like(c, F.lit(r"\s")), "space").when(F.regexp_like(c, F.lit(r"[\p{L}0-9]")), "word").otherwise("mark")
    form = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{L}+", "a")
    return each.select(
        "row", "kind", "weak", "start", "stop", valid.alias("base"),
        F.struct(vote(valid, ~F.col("weak")).alias("rule"), shape.alias("shape"), gazetteer.alias("gazetteer"), words.alias("words"), vote(F.lit(False), glued).alias("edges")).alias("votes"),
        F.array(F.concat(F.lit("form:"), kind, F.pmod(F.xxhash64(form), F.lit(SHAPES)).cast("string")), F.concat(F.lit("size:"), kind, F.least(F.lit(40), F.col("length")).cast("string")),
                F.concat(F.lit("digits:"), kind, F.least(F.lit(24), n).cast("string")), F.concat(F.lit("left:"), around(last)), F.concat(F.lit("right:"), around(F.col("right"))),
                F.concat(F.lit("shape:"), kind, shape.cast("string")), F.concat(F.lit("words:"), kind, words.cast("string"))).alias("features"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: P(true | pattern). Labelers are taken to
    be independent given the truth; it starts from the majority."""
    post = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in patterns}
    for _ in range(ROUNDS):
        yes = sum(post[v] * n for v, n in patterns)
        no = sum((1 - post[v]) * n for v, n in patterns)
        table = [{x: ((1 + sum(post[v] * n for v, n in patterns if v[k] == x)) / (3 + yes), (1 + sum((1 - post[v]) * n for v, n in patterns if v[k] == x)) / (3 + no)) for x in (-1, 0, 1)} for k in range(len(LABELERS))]
        for v in post:
            odds = math.log((yes + 1) / (no + 1)) + sum(math.log(table[k][x][0] / table[k][x][1]) for k, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classifier(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights by feature, from soft labels. What comes to the driver is
    bounded: vote patterns, then features with hashed values."""
    votes = spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    post = reliabilities([(tuple(r["votes"]), r["n"]) for r in votes])
    if not post:
        return 0.0, {}
    key = F.concat_ws(",", *[F.col(f"votes.{k}").cast("string") for k in LABELERS])
    soft = F.element_at(F.create_map(*[F.lit(x) for v, p in post.items() for x in (",".join(map(str, v)), p)]), key)
    held = spans.select("features", soft.alias("p"))
    total = held.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
    rows = held.select(F.explode("features").alias("f"), "p").groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    return math.log((total["yes"] + 1) / (total["no"] + 1)), {r["f"]: math.log((r["yes"] + 1) / (total["yes"] + 2)) - math.log((r["no"] + 1) / (total["no"] + 2)) for r in rows}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row, doc_id, text_key, spans`` (``kind, start, stop, base,
    p``, by kind as listed, then start). Repeated rows get a row each."""
    seen = scan(docs, id_col, text_col)
    each = stage(voted(seen.where(F.size("found") > 0)), "pii-votes")
    intercept, weights = classifier(each)
    if weights:
        table = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w)])
        score = F.lit(intercept) + F.aggregate("features", F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    else:
        score = F.lit(0.0)
    p = 1 / (1 + F.exp(-score))
    order = F.coalesce(*[F.when(F.col("kind") == k, n) for n, k in enumerate(KINDS)])
    likely = each.withColumn("p", p).where("base or p >= 0.5").withColumn("rank", order)
    # sorted by start, a span overlaps a base one if one before it ends later than it starts, or
    # one after it starts before it ends
    by_start = Window.partitionBy("row").orderBy("start")
    end_before = F.max(F.when(F.col("base"), F.col("stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    start_after = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    free = ~F.coalesce(end_before > F.col("start"), F.lit(False)) & ~F.coalesce(start_after < F.col("stop"), F.lit(False))
    apart = likely.withColumn("free", F.col("base") | free).where("free")
    # of weak spans that overlap, the one that starts first (then the longer) stays
    weak = F.when(~F.col("base"), F.col("stop"))
    in_turn = Window.partitionBy("row").orderBy("start", F.desc("stop"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    chosen = apart.withColumn("first", F.col("base") | (F.coalesce(F.max(weak).over(in_turn), F.lit(0)) <= F.col("start"))).where("first")
    kept = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "stop", "kind", "base", "p"))).alias("spans"))
    return seen.select("row", "doc_id", "text_key").join(kept, "row", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<rank:int,start:bigint,stop:bigint,kind:string,base:boolean,p:double>>")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span replaced by its kind in brackets; spans that
    overlap are replaced as one, under the first one's kind."""
    doc, key, spans = (fresh(n, docs.columns) for n in ("pii_doc", "pii_key", "pii_spans"))
    some = find(docs, id_col, text_col).where(F.size("spans") > 0).groupBy("doc_id", "text_key").agg(F.first("spans").alias("own"))
    some = some.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.array_sort(F.transform("own", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias(spans))
    text = F.col(text_col)

    def step(acc, s):
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.join(some, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(key)), "left")
    return joined.select(*[(F.when(F.col(spans).isNull(), text).otherwise(clean).alias(text_col) if n == text_col else F.col(f"`{n}`")) for n in docs.columns])
