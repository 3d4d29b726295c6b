"""Near-duplicate messages and spoofed adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import links_of, message_similarity, name_similarity, nfkc, normalised, normalised_name
from ..functions.columns import once, trigrams
from ..sources.sinks import shared_folder
from .graph import components
from .relational import in_days, shuffled, spread

#: Minutes without a message that part clusters; similarities of texts, and of texts and names together.
JOIN_MINUTES, SIMILAR, SIMILAR_WITH_NAME, NAME_SIMILAR = 30, 0.82, 0.60, 0.70
#: Fixed values of incidents: messages, messages in ten minutes, of a flood, least length, senders that make it chatter, a sender's share.
LEAST, BURST, BURST_MINUTES, FLOOD, CONTENT, SENDERS, DOMINANT = 8, 3, 10, 25, 12, 4, 0.6
#: Words that say nothing but that a link works.
BENIGN = (
    "test", "testing", "tested", "ack", "nack", "rx", "tx", "ping", "pong", "hello", "hi", "hey", "hiya", "gm", "gn", "morning", "evening", "afternoon",
    "cq", "hfcond", "qsl", "73", "ok", "yes", "no", "thanks", "ty", "lol",
)
#: Texts of similarity SIMILAR share this part of their trigrams at least: an edit costs up to three. Texts that are only alike
#: together with their names may share less, and are found if they share this.
SHARED = 0.45
#: Sessions of a network and a cell of time whose keys one task makes.
CELL_SESSIONS = 1000


def sessions(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with network, text and cell, the session of each text's cells, and the sessions of each text in a network: session,
    first, last, n, key (its first message), sender and links. A session ends with JOIN_MINUTES of silence.

    A text's messages are counted in cells of JOIN_MINUTES first, so the windows meet cells, not messages.
    """
    cell = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (JOIN_MINUTES * 60_000_000))
    m = messages.select("network", "conv_id", "turn", "time", "sender", nfkc(F.col("text")).alias("raw"))
    m = m.select("network", "conv_id", "turn", "time", "sender", normalised(F.coalesce("raw", F.lit(""))).alias("text"), links_of(F.coalesce("raw", F.lit(""))).alias("links"), cell.alias("cell"))
    first = F.min(F.struct("time", "conv_id", "turn", "sender", "links"))
    cells = m.groupBy("network", "text", "cell").agg(first.alias("head"), F.max("time").alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy("network", "text").orderBy("cell")
    gap = F.timestamp_diff("MICROSECOND", F.lag("last").over(w), F.col("head.time")) > JOIN_MINUTES * 60_000_000
    cells = cells.withColumn("part", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w))
    name = F.md5(F.concat_ws("|", "network", "text", F.col("part").cast("string")).cast("binary"))
    cells = cells.withColumn("session", name)
    whole = cells.groupBy("network", "text", "session").agg(F.min("head").alias("head"), F.max("last").alias("last"), F.sum("n").alias("n"))
    key = F.struct("head.time", "head.conv_id", "head.turn")
    whole = whole.select("network", "text", "session", F.col("head.time").alias("first"), "last", "n", key.alias("key"), normalised_name(F.coalesce("head.sender", F.lit(""))).alias("sender"), F.col("head.links").alias("links"))
    return m, cells.select("network", "text", "cell", "session"), whole


def _alike(a: str, b: str) -> Column:
    c = lambda side, x: F.col(f"{side}.{x}")
    text = message_similarity(c(a, "text"), c(b, "text"), c(a, "links"), c(b, "links"))
    names = name_similarity(c(a, "sender"), c(b, "sender")) >= NAME_SIMILAR
    return once(text, lambda t: (t >= SIMILAR) | ((t >= SIMILAR_WITH_NAME) & names))


def clusters(messages: DataFrame) -> DataFrame:
    """network, conv_id, turn, cluster (its first message's conv_id:turn) and size.

    Sessions of texts that are alike, in one network and within JOIN_MINUTES of each other, are one cluster, and so is
    all that these link. Sessions meet where they share a cell of time and a link or one of their first trigrams: of as
    many, in the order of their hashes, that texts which are alike can't miss each other.
    """
    spark = messages.sparkSession
    shared_folder(spark)
    # texts are few bytes and much work: dealt out by count
    m, cells, s = sessions(spread(messages, "conv_id", "turn"))
    s = s.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    cell = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (JOIN_MINUTES * 60_000_000))
    grams = F.array_sort(F.transform(trigrams(F.col("text")), lambda g: F.xxhash64(g)))
    keep = F.size(grams) - F.ceil(F.size(grams) * SHARED) + 1
    keys = F.concat(F.slice(grams, 1, keep.cast("int")), F.transform("links", lambda u: F.xxhash64(u)))
    # a session is sent once to each task that makes some of a cell's keys, so neither keys nor a pair's repetitions are sent
    at = s.select("network", "id", "text", "links", F.explode(F.sequence(cell("first"), cell("last") + 1)).alias("cell"))
    at = at.withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("network", "cell")) / CELL_SESSIONS))
    at = spread(at.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), "network", "cell", "part")
    own = F.filter(F.array_distinct(keys), lambda k: F.pmod(k, "parts") == F.col("part"))
    met = at.select("network", "cell", "part", "id", F.explode(own).alias("key")).groupBy("network", "cell", "part", "key").agg(F.collect_list("id").alias("ids"))
    pairs = met.select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).where("x < y").distinct()
    # what is compared comes to the pairs afterwards; that is few bytes and much work: dealt out by count
    held = F.struct("network", "text", "links", "sender", "first", "last")
    near = spread(pairs.join(shuffled(s.select(F.col("id").alias("x"), held.alias("a"))), "x"), "y").join(shuffled(s.select(F.col("id").alias("y"), held.alias("b"))), "y")
    apart = F.timestamp_diff("MICROSECOND", F.least("a.last", "b.last"), F.greatest("a.first", "b.first"))
    near = near.where((F.col("a.network") == F.col("b.network")) & (apart <= JOIN_MINUTES * 60_000_000))
    links = near.where(_alike("a", "b")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    group = components(links).withColumnsRenamed({"node": "id", "component": "root"})
    s = s.select("id", "session", "key", "n").join(shuffled(group), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = s.groupBy("root").agg(F.min("key").alias("k"), F.sum("n").alias("size"))
    named = s.join(shuffled(of), "root").select("session", F.concat_ws(":", F.col("k.conv_id").cast("string"), F.col("k.turn").cast("string")).alias("cluster"), "size")
    told = cells.join(shuffled(named), "session").drop("session")
    return m.join(shuffled(told), ["network", "text", "cell"]).select("network", "conv_id", "turn", "cluster", "size")


def incidents(clustered: DataFrame, messages: DataFrame, least: int = LEAST) -> DataFrame:
    """Clusters of ``least`` messages or more that look like one actor's, with what speaks for it and a score from 0 to 1.

    Left out are short and benign texts without a link, and what many unlike senders say. Senders rotate if two of their
    names are alike.
    """
    m = spread(messages, "conv_id", "turn").select("conv_id", "turn", "time", normalised_name(F.coalesce("sender", F.lit(""))).alias("sender"), normalised(F.coalesce("text", F.lit(""))).alias("text"), links_of(F.coalesce("text", F.lit(""))).alias("links"))
    j = clustered.where(F.col("size") >= least).join(shuffled(m), ["conv_id", "turn"]).checkpoint()
    by = ["network", "cluster"]
    day = in_days(j.select(*by, "time"), "time", BURST_MINUTES * 60_000_000)
    w = Window.partitionBy(*by, "day").orderBy("us").rangeBetween(-BURST_MINUTES * 60_000_000, 0)
    burst = day.withColumn("b", F.count("*").over(w)).groupBy(*by).agg(F.max("b").alias("burst"))
    texts = j.groupBy(*by, "text").agg(F.count("*").alias("c"), F.min("time").alias("t"), F.first("links").alias("links"))
    modal = texts.groupBy(*by).agg(F.max_by("text", F.struct("c", -F.unix_micros(F.col("t").cast("timestamp")), "text")).alias("text"))
    urls = j.select(*by, "conv_id", "turn", F.explode(F.array_distinct("links")).alias("url")).groupBy(*by, "url").count().groupBy(*by).agg(F.max("count").alias("url_repeats"))
    senders = j.groupBy(*by, "sender").agg(F.count("*").alias("c")).checkpoint()
    who = senders.groupBy(*by).agg(F.count_if(F.col("sender") != "").alias("senders"), F.max("c").alias("most"))
    gram = senders.where("sender != ''").select(*by, "sender", F.explode(trigrams(F.col("sender"))).alias("g"))
    alike = gram.join(shuffled(gram.withColumnRenamed("sender", "other")), [*by, "g"]).where("sender < other").select(*by, "sender", "other").distinct()
    rotates = alike.where(name_similarity(F.col("sender"), F.col("other")) >= NAME_SIMILAR).select(*by, F.lit(True).alias("rotates")).distinct()
    c = j.groupBy(*by).agg(F.count("*").alias("messages"), F.min("time").alias("first"), F.max("time").alias("last"))
    for t in (burst, modal, urls, who, rotates):
        c = c.join(shuffled(t), by, "left")
    c = c.fillna(0, ["url_repeats"]).fillna(False, ["rotates"])
    words = F.filter(F.split("text", " "), lambda x: (x != "") & ~x.startswith("url:"))
    real = F.filter(words, lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$") & ~x.isin(*BENIGN))
    link, share = F.col("url_repeats") > 0, F.col("most") / F.col("messages")
    senders_n = F.greatest(F.lit(1), F.col("senders"))
    chatter = (senders_n > SENDERS) & ~F.col("rotates") & (share < DOMINANT)
    suspicious = (senders_n <= 1) | (share >= DOMINANT) | F.col("rotates")
    benign = F.forall(words, lambda x: x.isin(*BENIGN))
    fits = ((F.length("text") >= CONTENT) | link) & ~(benign & ~link) & ~chatter & (suspicious | link) & (F.col("burst") >= BURST)
    testing = (F.size(real) == 0) & ~link & ~F.col("rotates")
    score = 0.3 * F.least(F.lit(1.0), (F.col("messages") - least + 1) / 8.0) + 0.2 * F.least(F.lit(1.0), F.col("burst") / float(max(BURST * 2, 4)))
    score = score + F.when(F.col("url_repeats") >= 2, 0.2).when(link, 0.1).otherwise(0.0) + F.when(F.col("rotates"), 0.25).when((senders_n <= 1) & (share >= 0.8), 0.1).otherwise(0.0)
    score = score + F.when((F.col("messages") >= FLOOD) & ~testing, 0.2).otherwise(0.0)
    score = F.least(F.lit(1.0), F.when(testing, score * 0.6).otherwise(score))
    return c.where(fits).select(*by, "messages", "first", "last", "text", "senders", "rotates", "burst", "url_repeats", F.round(score, 6).alias("score"))


def advert_evidence(adverts: DataFrame) -> DataFrame:
    """src_node_id, its packets, hours with any, and the most in a minute."""
    minute = adverts.groupBy("src_node_id", F.date_trunc("minute", "time").alias("minute")).agg(F.count("*").alias("n"))
    return minute.groupBy("src_node_id").agg(F.sum("n").alias("packets"), F.count_distinct(F.date_trunc("hour", "minute")).alias("hours"), F.max("n").alias("most_a_minute"))


def advert_verdicts(evidence: DataFrame, burst: int = 30, strong: int = 10) -> DataFrame:
    """spam for bursts with much evidence, suspect for either, else clean."""
    hot, much = F.col("most_a_minute") > burst, F.col("packets") >= strong
    return evidence.withColumn("verdict", F.when(hot & much, "spam").when(hot | (much & (F.col("hours") <= 1)), "suspect").otherwise("clean"))
