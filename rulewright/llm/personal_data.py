r"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Regular expressions with checks (octets, Luhn, digit counts) give the base entities.
They seed a bipartite graph: lexical patterns (the word before or after a mention, with the
coarse kind of the mention) against instances (the mentions' texts).  A few rounds of scoring, each
two pre-aggregated group-bys, pass confidence from seeds to patterns and from patterns to
instances; mentions of instances that high-confidence, well-supported patterns
extract are added to the base spans.  What looks like a base kind but failed its check is never added.

Defined results: a null text counts as empty and has no spans; every row is kept, with
its base spans; repeated rows get equal results; rows without doc_id take part; an empty table
gives an empty result.  Extra columns are ignored by ``find`` and carried by ``mask``.
Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, spread

KINDS = ["email", "ip", "card", "phone"]
#: Possessive quantifiers keep Java's matcher iterative; the look-behinds start each attempt where a
#: run starts (or where the last match ended), so long runs cost linear time.  Neither changes the matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A mention: a phone-like or card-like run of words, an address-like word (with @, or with a bracketed at, which blanks
#: may surround), a number of three groups, any other run of spaced or parenthesised numbers, or one word that holds a digit.
_SP, _DOT = r"\x20\x09-\x0D", r"\x20?[\[({](?i:dot)[\])}]\x20?"
_LED, _ENDS = rf"(?<![^{_SP}])", rf"(?![^{_SP}\p{{P}}])"
AT = r"[\[({](?i:at)[\])}]"
ADDRESS = rf"{_LED}[^{_SP}@]++@[^{_SP}]++|{_LED}[^{_SP}\[({{]++\x20?{AT}\x20?[^{_SP}\[({{]++(?:{_DOT}[^{_SP}\[({{]++)*+"
GROUPS = rf"{_LED}[(\[]?(?:[0-9]{{1,3}}[\x20.-]{{1,2}})?\(?[0-9]{{2,4}}\)?[\x20./-]{{0,2}}[0-9]{{3,4}}[\x20.-]{{1,2}}[0-9]{{3,4}}(?![0-9]|[.-][0-9]){_ENDS}"
NUMBERS = rf"{_LED}[(\[]?[0-9]++(?:[\x20()./-]{{1,3}}+[0-9]++)*+{_ENDS}"
MENTION = rf"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){{13,}}+|{ADDRESS}|{GROUPS}|{NUMBERS}|{_LED}[^{_SP}0-9]*+[0-9][^{_SP}]*+"
#: Kinds of numbers: what is written like a date isn't like a phone number, whatever its digits.
DATE = r"^(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4})$"
#: A pattern must extract so many distinct seeds, its seeds must make this share of its weight,
#: and an instance needs this score, to be believed.
SUPPORT, CONFIDENCE, BELIEVED, ROUNDS = 5, 0.95, 0.9, 3


def _edge_word(gap: Column, last: bool) -> Column:
    """The last or first word of a gap, in lower case and without outer punctuation; "" if there is none."""
    word = F.regexp_extract(gap, rf"{_LED}([^{_SP}]++)[{_SP}]*+$" if last else rf"^[^\p{{L}}\p{{N}}]*+([^{_SP}]++)", 1)
    return _bounded(F.lower(F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]++", ""), r"[^\p{L}\p{N}]++$", "")))


def _bounded(c: Column) -> Column:
    """``c``, or its SHA-256 if it is long: what serves as a key alone needn't be carried whole."""
    return F.when(F.length(c) > 64, F.sha2(c.cast("binary"), 256)).otherwise(c)


def spans(text: Column, regex: str, around: bool = False) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches.  With ``around``, also
    the word ``before`` in the text between the last match and this one, and the word ``after`` in that up to the next one."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    kind = "struct<start:long,end:long,value:string>"
    if around:
        kind = kind[:-1] + ",before:string,after:string>"
        pairs = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.greatest(F.size(found), F.lit(1))), lambda p, a: F.struct(p["g"].alias("g"), p["m"].alias("m"), a.alias("a")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["g"])
        e = s + F.length(p["m"])
        more = [_edge_word(p["g"], True).alias("before"), _edge_word(p["a"], False).alias("after")] if around else []
        one = F.struct(s.alias("start"), e.alias("end"), p["m"].alias("value"), *more).cast(kind)
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, start, add)["out"]).otherwise(F.array().cast(f"array<{kind}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    """The checked base spans of each kind; ``text`` must not be null."""
    empty = F.array().cast("array<struct<start:long,end:long,value:string>>")
    digits = text.rlike("[0-9]")
    ok = {"email": lambda s: F.lit(True), "ip": lambda s: _octets(s["value"]), "card": lambda s: _luhn(s["value"]), "phone": lambda s: F.length(_digits(s["value"])).between(10, 15)}
    when = {"email": F.contains(text, F.lit("@")), "ip": digits, "card": digits, "phone": F.contains(text, F.lit("+"))}
    regex = dict(zip(KINDS, [EMAIL, IP, CARD, PHONE], strict=True))
    return {k: F.when(when[k], F.filter(spans(text, regex[k]), ok[k])).otherwise(empty) for k in KINDS}


def _tagged(c: Column, kind: Column | str, order: int) -> Column:
    return F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def with_base(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, key (128 bits of doc_id and text), the columns of ``keep``, n_<kind> and base: the spans by start, then kind as listed."""
    t = docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    t = t.select("doc_id", *keep, F.unhex(F.md5(F.concat_ws("\t", F.col("doc_id").cast("string"), "_t").cast("binary"))).alias("key"), "_t", *(c.alias(k) for k, c in base_spans(F.col("_t")).items()))
    merged = F.array_sort(F.concat(*(_tagged(F.col(k), k, i) for i, k in enumerate(KINDS))))
    return t.select("doc_id", *keep, "key", "_t", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), merged.alias("base"))


def text_of(merged: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _coarse(value: Column, core: Column) -> Column:
    """The coarse kind of a mention: an address, a number by its range of digits with separators and + folded, else the shape of the word."""
    n = F.length(_digits(core))
    number = F.when(value.rlike(r"^[^\p{L}\p{N}]*\+"), "#phone").when(core.rlike(DATE), "#date").when(core.rlike(f"^{IP}$"), "#ip").when(n < 7, "#short").when(n < 14, "#phone").otherwise("#card")
    shape = _bounded(F.regexp_replace(F.regexp_replace(core, "[0-9]++", "9"), r"\p{L}++", "a"))
    return F.when(value.rlike(f"@|{AT}"), "#address").when(core.rlike(r"^[0-9\x20()./-]++$"), number).otherwise(shape)


def _mentions(t: DataFrame) -> DataFrame:
    """A row per mention and pattern: key, start, end, value (without outer punctuation), pattern (the word
    before or after, with the coarse kind), kind (of the base span it overlaps, else null), refused."""
    m = t.where(F.col("_t").rlike(f"[0-9@]|{AT}")).select("key", "base", F.explode(spans(F.col("_t"), MENTION, around=True)).alias("m"))
    lead = F.length(F.regexp_extract("m.value", r"^[^\p{L}\p{N}]*+", 0))
    core = F.regexp_replace(F.regexp_replace("m.value", r"^[^\p{L}\p{N}]++", ""), r"[^\p{L}\p{N}]++$", "")
    refused = core.rlike(f"{CARD}|{IP}") | F.col("m.value").rlike(PHONE)  # looks like a base kind and failed its check, unless a base span covers it
    start = (F.col("m.start") + lead).alias("start")
    rows = m.select("key", "base", refused.alias("refused"), start, (start + F.length(core)).alias("end"), _bounded(core).alias("value"), _coarse(F.col("m.value"), core).alias("coarse"), F.col("m.before").alias("before"), F.col("m.after").alias("after")).where("value <> ''")
    hit = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    sides = F.filter(F.array(*(F.when(F.length(w) > 0, F.concat_ws("\t", F.lit(w), w, "coarse")) for w in ("before", "after"))), lambda p: p.isNotNull())
    return rows.select("key", "start", "end", "value", F.explode(sides).alias("pattern"), F.when(F.size(hit) > 0, F.element_at(hit, 1)["kind"]).alias("kind"), "refused")


def discover(t: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """key, extra: the spans that believed patterns add to the base, a row per document text that gets any.  Only patterns
    that extract enough seeds, all of one kind, can be believed, so the graph holds no others.  Common words and values are hot keys."""
    mentions = scratch.stash(_mentions(t), "mentions")
    graph = scratch.stash(mentions.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "graph")
    able = graph.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.max("kind").alias("takes"), F.min("kind").alias("least"), F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_m"))
    able = scratch.stash(able.where(f"seeds >= {SUPPORT} AND takes = least").select("pattern", "takes", "_n", "_m"), "able")
    graph = scratch.stash(hot_join(graph, able.select("pattern", "_n"), "pattern"), "able-graph")
    instances = graph.groupBy("value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("_n")).select("value", F.col("kind").isNotNull().cast("double").alias("score"), "_n")
    for _ in range(rounds):
        instances = scratch.stash(instances, "instances")
        weight = F.log1p("n")
        patterns = hot_join(graph, instances, "value").groupBy("pattern").agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("confidence"), F.count(F.lit(1)).alias("_n"))
        patterns = scratch.stash(patterns, "patterns")
        reach = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        reached = hot_join(graph, patterns, "pattern").groupBy("value").agg(F.max("kind").alias("kind"), reach.alias("reach"), F.count(F.lit(1)).alias("_n"))
        instances = reached.select("value", F.when(F.col("kind").isNotNull(), F.lit(1.0)).otherwise(F.col("reach")).alias("score"), "_n")
    believed = scratch.stash(instances.where(f"score >= {BELIEVED}").select("value", "_n"), "believed")
    sure = scratch.stash(patterns.where(f"confidence >= {CONFIDENCE}").drop("_n").join(able.select("pattern", "takes", "_m"), "pattern"), "sure")
    new = hot_join(hot_join(mentions.where("kind IS NULL AND NOT refused"), sure, "pattern", "_m"), believed, "value")
    new = new.groupBy("key", "start", "end").agg(F.max_by("takes", F.struct("confidence", "takes")).alias("takes"))
    one = F.struct(F.col("start"), F.lit(len(KINDS)).alias("order"), F.col("takes").alias("kind"), F.col("end"))
    return scratch.stash(new.groupBy("key").agg(F.collect_set(one).alias("extra")), "extra")


def find(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (both as arrays of start, order, kind, end): a row per row."""
    t = with_base(docs)
    extra = discover(t, scratch)
    out = t.drop("_t").join(extra, "key", "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(extra.schema["extra"].dataType)))).alias("spans"))


def mask(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; n_chars, if there, follows."""
    extra = discover(with_base(docs), scratch)
    rest = [c for c in docs.columns if c != "doc_id"]
    held = docs.select("doc_id", F.struct(*rest).alias("_row"), "text")
    t = with_base(held, "_row").join(extra, "key", "left")
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(extra.schema["extra"].dataType))))
    t = t.select("doc_id", "_row", "_t", both.alias("s"))
    # A span that starts before an earlier one ends is joined to it.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:long,start:long,end:long,kind:string>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        one = F.struct(acc["at"].alias("from"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["kind"].alias("kind"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"].cast("long")).alias("at"), more.alias("out"))

    cut = F.aggregate("s", start, add)
    t = t.select("doc_id", "_row", "_t", cut.alias("cut"))
    piece = F.transform("cut.out", lambda p: F.concat(F.substring("_t", (p["from"] + 1).cast("int"), (p["start"] - p["from"]).cast("int")), F.lit("<"), F.upper(p["kind"]), F.lit(">")))
    masked = F.concat(F.array_join(piece, ""), F.substring("_t", (F.col("cut.at") + 1).cast("int"), F.lit(2**31 - 1)))
    new = F.when(F.size("cut.out") > 0, masked).otherwise(F.col("_row.text"))
    col = {c: F.col(f"_row.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": new}
    if "n_chars" in rest:
        col["n_chars"] = F.when(F.size("cut.out") > 0, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return t.select(*(col[c].alias(c) for c in docs.columns))


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))
