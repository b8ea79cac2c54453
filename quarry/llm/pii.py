"""Personal data by pattern, and by bootstrapped contexts, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.spark import documents, release, stash, text_key

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_SPACE = r"\x20\x09-\x0D"
#: The base patterns, written so that matching takes linear time on any text: possessive where giving back can't help,
#: and only tried where a run starts (or the last match ended).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
TRIGGER = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words with a digit, an @ or one spelt out in brackets: where unseen identifiers are looked for.
MENTION = rf"(?<![^{_SPACE}])(?:[^{_SPACE}0-9@]*+[0-9@]|[^{_SPACE}(\[{{]*+[(\[{{](?:at|AT|dot|DOT)[)\]}}])[^{_SPACE}]*+"
MENTIONED = r"[0-9@]|[(\[{](?:at|AT|dot|DOT)[)\]}]"
#: Matches of a text whose places are summed together.
BLOCK = 128
#: Rounds of scoring; distinct seeds a pattern needs; confidence of patterns and score of instances that count.
ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.8
#: Weight of an instance of unknown kind in a pattern's confidence.
DOUBT = 0.5
#: Digits that make a shape a pattern of its own, without words around it.
TELLING = 7
#: Code points of a text in which mentions and base spans are brought together.
STRETCH = 512
#: Digits of a whole phone and card number, and those that pieces must have together.
WHOLE = {3: 10, 2: 14}
LEAST = {3: 7, 2: 12}
#: Words around mentions up to which they are broadcast (some 20 bytes each); beyond, a shuffle join.
BROADCAST = 200_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$") & ~value.rlike(r"\.$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    return n.between(10, 15)


def _place(df: DataFrame, name: str) -> DataFrame:
    """df with l_name, the code points from the end of each match's predecessor to its own, and s_name, their sums before each block of BLOCK."""
    size = F.size(f"m_{name}")
    df = df.withColumn(f"l_{name}", F.transform(f"m_{name}", lambda m, i: F.length(F.get(f"g_{name}", i)) + F.length(m)))
    each = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(f"l_{name}", k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, y: x + y))
    zero = F.from_json(F.lit('{"at":0,"out":[]}'), "struct<at:int,out:array<int>>")
    sums = F.aggregate(each, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    return df.withColumn(f"s_{name}", F.when(size > 0, sums).otherwise(F.array().cast("array<int>")))


def _found(name: str) -> Column:
    """Array of (start, end, value, before, after): matches with their places in code points and the gaps around them.

    A place is the sum before its block and of its predecessors in the block, so
    texts with very many matches don't cost their square.
    """
    gap = lambda i: F.get(f"g_{name}", i)

    def one(m, i):
        block = F.floor(i / BLOCK).cast("int")
        until = F.get(f"s_{name}", block) + F.aggregate(F.slice(f"l_{name}", block * BLOCK + 1, i - block * BLOCK + 1), F.lit(0), lambda x, y: x + y)
        return F.struct((until - F.length(m)).cast("bigint").alias("start"), until.cast("bigint").alias("end"), m.alias("value"), gap(i).alias("before"), gap(i + 1).alias("after"))

    return F.transform(f"m_{name}", one)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with ``base``, the sorted array of (start, kind, end), ``mentions``, and the text's key instead of the text."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for name, pattern in (*PATTERNS.items(), ("mention", MENTION)):
        tried = F.instr("text", TRIGGER[name]) > 0 if TRIGGER.get(name) else F.col("text").rlike(MENTIONED)
        none = F.array().cast("array<string>")
        out = out.withColumn(f"m_{name}", F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        out = out.withColumn(f"g_{name}", F.when(F.size(f"m_{name}") > 0, F.split("text", pattern, -1)).otherwise(none))
        out = _place(out, name)
    spans = []
    for i, kind in enumerate(KINDS):
        good = F.filter(_found(kind), lambda s: _valid(kind, s["value"]))
        spans.append(F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))))
    blank = lambda gap: F.trim(F.translate(gap, "\t\n\x0b\x0c\r", " " * 5))
    word = lambda gap, last: F.lower(F.substring_index(blank(gap), " ", -1 if last else 1))
    beside = lambda gap, i: F.when((i >= 0) & (F.length(gap) > 0) & (blank(gap) == ""), F.get("m_mention", i))
    mentions = F.transform(
        _found("mention"),
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), word(s["before"], True).alias("left"), word(s["after"], False).alias("right"),
            beside(s["before"], i - 1).alias("previous"), beside(s["after"], i + 1).alias("next"),
        ),
    )
    return out.select("doc_id", text_key().alias("text_key"), F.array_sort(F.concat(*spans)).alias("base"), mentions.alias("mentions"))


def _core(value: Column) -> tuple[Column, Column]:
    """(code points before, and after) what is the identifier in a mention: quotes, brackets and marks around it are not part of it."""
    return F.length(F.regexp_extract(value, r"""^["'(\[<]++""", 0)), F.length(F.regexp_extract(value, r"""(?<!["')\]>.,;:!?*#$%&])["')\]>.,;:!?*#$%&]++$""", 0))


def _shape(core: Column) -> Column:
    """What an identifier looks like: runs of letters as a, of digits as 9, of both as x; its number of digits; whether it passes the check of a card or an address."""
    runs = F.regexp_replace(core, r"[a-z0-9\x{80}-\x{10FFFF}]*+(?<=[a-z\x{80}-\x{10FFFF}])[0-9][a-z0-9\x{80}-\x{10FFFF}]*+|[0-9]++[a-z\x{80}-\x{10FFFF}][a-z0-9\x{80}-\x{10FFFF}]*+", "x")
    runs = F.regexp_replace(F.regexp_replace(runs, "[0-9]++", "9"), r"[a-wyz\x{80}-\x{10FFFF}][a-z\x{80}-\x{10FFFF}]*+", "a")
    passes = F.when(core.rlike("^[0-9 -]+$") & _valid("card", core), "+card").when(core.rlike(r"^[0-9]+(\.[0-9]+){3}$") & _valid("ip", core), "+ip").otherwise("")
    return F.concat(F.substring(runs, 1, 40), F.lit(":"), F.least(F.length(_digits(core)), F.lit(20)).cast("string"), passes)


def _kinds(found: DataFrame) -> DataFrame:
    """text_key, start, kind of mentions that base spans overlap.

    Both are dealt to stretches of their text and joined there, so a text with
    very many of them doesn't cost their square.
    """
    stretches = lambda s, e: F.explode(F.sequence(F.floor(s / STRETCH), F.floor((e - 1) / STRETCH))).alias("stretch")
    one = found.select("text_key", F.explode("base").alias("b")).select("text_key", F.col("b.start").alias("s"), F.col("b.end").alias("e"), F.col("b.kind").alias("kind"))
    many = found.select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.start", "m.end")
    one, many = one.distinct().select("*", stretches(F.col("s"), F.col("e"))), many.distinct().select("*", stretches(F.col("start"), F.col("end")))
    meet = many.join(one, ["text_key", "stretch"]).where((F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    return meet.groupBy("text_key", "start").agg(F.min(F.struct("s", "kind")).alias("first")).select("text_key", "start", F.col("first.kind").alias("kind"))


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each mention of a distinct text: place, digits, instance, kind of the base span it lies in (or null), patterns.

    A pattern is what stands on the left, on the right, or both: a word, or the
    shape of another mention right beside; with the mention's own shape, and
    for words also without.  A telling shape is a pattern by itself.
    """
    rows = found.where(F.size("mentions") > 0).select("text_key", F.explode("mentions").alias("m")).distinct()
    rows = rows.join(_kinds(found).withColumnRenamed("text_key", "k").withColumnRenamed("start", "s"), (F.col("text_key") == F.col("k")) & (F.col("m.start") == F.col("s")), "left")
    lead, tail = _core(F.col("m.value"))
    rows = rows.withColumn("start", F.col("m.start") + lead).withColumn("end", F.col("m.end") - tail).where(F.col("start") < F.col("end"))
    core = F.lower(F.expr("substring(m.value, int(start - m.start) + 1, int(end - start))"))
    rows = rows.withColumn("core", core).withColumn("shape", _shape(F.col("core")))
    for side in ("previous", "next"):
        a, b = _core(F.col(f"m.{side}"))
        rows = rows.withColumn(side, F.when(F.col(f"m.{side}").isNotNull(), F.concat(F.lit("#"), _shape(F.lower(F.col(f"m.{side}").substr(a + 1, F.length(f"m.{side}") - a - b))))))
    rows = rows.withColumn("left", F.coalesce("previous", F.nullif(F.col("m.left"), F.lit("")))).withColumn("right", F.coalesce("next", F.nullif(F.col("m.right"), F.lit(""))))
    shaped = [F.concat_ws("|", F.lit(name), *map(F.col, sides), "shape") for name, *sides in (("L", "left"), ("R", "right"), ("B", "left", "right"))]
    words = [F.concat_ws("|", F.lit(name), *map(F.col, sides), F.lit("any")) for name, *sides in (("L", "left"), ("R", "right"), ("B", "left", "right"))]
    has = [F.col("left").isNotNull(), F.col("right").isNotNull(), F.col("left").isNotNull() & F.col("right").isNotNull()]
    worded = [has[0] & F.col("previous").isNull(), has[1] & F.col("next").isNull(), has[2] & F.col("previous").isNull() & F.col("next").isNull()]
    telling = (F.length(_digits(F.col("core"))) >= TELLING) | F.instr("core", "@").cast("boolean") | F.col("core").rlike(r"[(\[{](at|dot)[)\]}]")
    patterns = F.array_compact(F.array(*(F.when(ok, p) for ok, p in zip((*has, *worded), (*shaped, *words))), F.when(telling, F.concat(F.lit("S|"), "shape"))))
    digits = F.length(_digits(F.col("core")))
    # a piece of a number, such as a country's code, is an instance with what stands right beside it
    instance = F.when(digits < TELLING, F.concat_ws(" ", "m.previous", "core", "m.next")).otherwise(F.col("core"))
    return rows.select("text_key", "start", "end", digits.alias("digits"), F.sha2(instance, 256).alias("instance"), "kind", patterns.alias("patterns"))


def _occurrences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, times: how often each of the words stands in the texts."""
    each = F.explode(F.split(F.lower(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)), " ")).alias("word")
    every = docs.where("text is not null").select(each)
    return every.join(F.broadcast(words) if words.count() <= BROADCAST else words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"))


def _selective(patterns: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, share: of the places where a pattern's word stands (of two words the one with more), the share with a mention on that side; only patterns without a shape.

    A word like "the" stands beside everything, so seeds beside it say nothing:
    every other place of it is a negative example.
    """
    bare = patterns.where(F.col("pattern").endswith("|any"))
    parts = F.split("pattern", r"\|")
    words = F.slice(parts, F.lit(2), F.size(parts) - 2)
    side = lambda w, i: F.struct(w.alias("word"), F.when((parts[0] == "R") | (i == 1), "R").otherwise("L").alias("side"))
    bare = bare.select("pattern", F.explode(F.transform(words, side)).alias("x")).select("pattern", "x.word", "x.side")
    words = stash(bare.select("word").distinct(), "words")
    times = _occurrences(docs, words)
    sides = F.array(F.struct(F.col("m.left").alias("word"), F.lit("L").alias("side")), F.struct(F.col("m.right").alias("word"), F.lit("R").alias("side")))
    beside = found.select(F.explode("mentions").alias("m")).select(F.explode(sides).alias("x")).select("x.word", "x.side")
    beside = beside.join(F.broadcast(words) if words.count() <= BROADCAST else words, "word", "left_semi").groupBy("word", "side").agg(F.count("*").alias("beside"))
    share = times.join(beside, "word").select("word", "side", F.least(F.col("beside") / F.col("times"), F.lit(1.0)).alias("share"))
    out = stash(bare.join(share, ["word", "side"]).groupBy("pattern").agg(F.max("share").alias("share")), "shares")
    release(words)
    return out


def discovered(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(text_key, kind, start, end) of spans that the bootstrapped contexts add.

    Mentions in base spans are seeds.  Patterns and instances form a graph: a
    pattern's confidence in a kind is the mean score of its distinct instances
    (seeds of other kinds count against it whole, unknown ones by DOUBT, and half
    an instance in any case), times the share of its word's places that have a
    mention where the pattern is words alone; an instance's score is the
    chance that one of its trusted patterns is right, a seed's 1; this is
    repeated ROUNDS times over edges on the executors.  Pieces of a phone or card
    number that follow each other become one span; too few digits are none.
    """
    mentions = stash(_mentions(found), "mentions")
    edges = stash(mentions.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    support = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("known"))
    trusted = stash(support.join(size, "pattern").select("pattern", "kind", "n", "known"), "support")
    share = _selective(trusted.select("pattern").distinct(), found, docs)
    links = stash(edges.select("pattern", "instance").join(trusted.select("pattern").distinct(), "pattern", "left_semi"), "links")
    bare = F.when(F.col("pattern").endswith("|any"), F.coalesce("share", F.lit(0.0))).otherwise(1.0)
    used = [mentions, edges, links, trusted, share]
    trusted = stash(trusted.join(share, "pattern", "left").withColumn("share", bare), "trusted")
    scores = seeds
    used.append(trusted)
    # unknown instances weigh less than known ones, until they have a score of their own
    weight = F.greatest(F.col("known") + DOUBT * (F.col("n") - F.col("known")), F.col("sum"))
    for _ in range(ROUNDS):
        confidence = links.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).join(trusted, ["pattern", "kind"])
        confidence = stash(confidence.select("pattern", "kind", (F.col("share") * F.least(F.col("sum") / (weight + 0.5), F.lit(1.0))).alias("confidence")), "confidence")
        reached = links.join(confidence.where(F.col("confidence") >= CONFIDENT), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = stash(seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")), "scores")
        used += [confidence, scores]
    sure = confidence.where(F.col("confidence") >= CONFIDENT)
    new = mentions.where("kind is null").select("text_key", "start", "end", "digits", "instance", F.explode("patterns").alias("pattern"))
    new = new.join(sure, "pattern").join(scores.where(F.col("score") >= CONFIDENT), ["instance", "kind"])
    new = new.groupBy("text_key", "start", "end", "digits").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    out = stash(_whole(new.select("text_key", "start", "end", "digits", (-F.col("best.k")).alias("kind"))), "discovered")
    release(*used)
    return out


def _whole(new: DataFrame) -> DataFrame:
    """text_key, kind, start, end: pieces of one number (of too few digits each, a bracket and a space apart at most) as one span."""
    whole, least = (F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in x.items()), F.lit(0)) for x in (WHOLE, LEAST))
    piece = F.col("digits") < whole
    before = Window.partitionBy("text_key").orderBy("start", "end")
    goes_on = piece & F.lag(piece).over(before) & (F.lag("kind").over(before) == F.col("kind")) & (F.col("start") - F.lag("end").over(before) <= 3)
    runs = new.withColumn("first", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("first").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("text_key", "run", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("digits").alias("digits"))
    return runs.where(F.col("digits") >= least).select("text_key", "kind", "start", "end")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row.

    The counts and base_sha256 are of the base patterns (leftmost matches that
    don't overlap within a kind; those that fail their check are dropped); spans
    adds what the contexts discovered, in the same form (ties by kind, then
    end).  Offsets are code points, end exclusive.  Null and empty texts have no
    spans; an empty table gives no rows; repeated rows stay.  Copies of a text
    count once as evidence and all get its spans.  Very long texts are searched
    whole, in time of their length and number of matches.  Extra columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = stash(base_spans(docs), "pii")
    added = discovered(found, docs)
    rows = stash(found.drop("mentions"), "base")  # the mentions, in clear, go
    release(found)
    added = added.groupBy(F.col("text_key").alias("k")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    out = rows.join(added, F.col("text_key") == F.col("k"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_added"))


def op6_pii(spark, sf_dir):
    return find_pii(documents(spark, sf_dir))
