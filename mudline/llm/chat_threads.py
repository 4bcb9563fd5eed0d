"""Chat formatting by quotation linking (operator 8), in DataFrame functions only.

Lines that begin with ``>`` marks are quoted, one level per mark.  Contiguous
lines of one level are a passage; so are contiguous lines that a message says
itself.  A passage is normalised across its line ends (lower case, runs of other
characters than letters and digits become one space), so a quote that a mail
client wrapped anew stays the same.  Each run of ``WINDOW`` words of a passage is
hashed; a passage of fewer words is hashed whole, and so is each line of fewer
words that a message says itself.

A window belongs to the first message of its conversation that said it.  A quoted
passage belongs to the earlier message that first said most of its windows, half
of them at least; the latest of equals.  A message replies to the message of its
quoted passage of the lowest level, with most characters, then latest.  Threads
are the trees of these links; every message carries its thread's root, its depth,
its position in the thread read in reply order (each message, then its replies by
turn, each with its own), its text without quotes and without the line that
introduces a quote, and that text in chat form: sorted by conversation, thread
root and position these are the conversations.  ``n_verbatim`` tells how many of the linked
passages stand word for word in the message that they are linked to.

Each (conversation, window) keeps only its first turn before the join, so a line
that thousands of messages share meets each quote once.  Messages without a mark
are their own clean text; only conversations with a mark are cut into passages,
which are written once.  Roots come from pointer jumping over the links, and positions
from ranking the list "first reply, else next reply to the nearest message above
that has one", in rounds written to the shared folder, each of which replaces the
one before; no conversation is gathered into one task.

Defined results: null and empty texts have an empty text and no link; messages
without conversation or turn are their own roots without links; repeated rows
stay repeated; rows that share conversation and turn have links of their own, and
replies to that turn go on from the largest of them; a message never replies to a
later turn or to itself; a very long text costs time in proportion to its length;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.llm.shared import discard, new_dir, written, written_at

WINDOW = 5
MARKS = r"^((?:[ \t]*>)+)"
INTRODUCES = r"wrote:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def windows(words: str) -> Column:
    """Hashes of each run of ``WINDOW`` words, or of the whole of fewer words; ``words`` is a column of its own, as a split in here would be done for each run."""
    words = F.col(words)
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")))
    return F.array_distinct(long)


def rows_of(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages with ``mark`` (of the text) and ``quotes``: whether a line may begin with a quote mark."""
    column = lambda c: F.col(f"`{c}`")
    rows = chats.select(column(conv_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), column(role_col).alias("role"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return rows.withColumns({"mark": F.xxhash64("text"), "quotes": F.col("text").rlike(r"(?m)^[ \t]*>")})


def messages_of(rows: DataFrame) -> DataFrame:
    """Messages with ``own`` (their own lines), ``n_quoted`` and ``passages`` (kind: level, 0 for own words, -1 for introductions; place; norm)."""
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    levels = rows.withColumn("levels", F.transform("lines", level))
    after = lambda i: F.coalesce(F.get("levels", i + 1), F.lit(0))
    kind = lambda x, i: F.when(F.get("levels", i) > 0, F.get("levels", i)).when((after(i) > 0) & x.rlike(INTRODUCES), F.lit(-1)).otherwise(F.lit(0))
    kinds = levels.withColumn("kinds", F.transform("lines", kind))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get("kinds", i) != F.get("kinds", i - 1)))
    cut = kinds.withColumn("begins", begins).withColumn("plain", F.transform("lines", lambda x: F.regexp_replace(x, MARKS, "")))
    passage = lambda b, k: F.struct(
        F.get("kinds", b).alias("kind"), k.alias("place"), normal(F.array_join(F.slice("plain", b + 1, F.coalesce(F.get("begins", k + 1), F.size("plain")) - b), " ")).alias("norm")
    )
    own = F.filter("lines", lambda _, i: F.get("kinds", i) == 0)
    return cut.select("conv_id", "turn", "role", "mark", own.alias("own"), F.size(F.filter("kinds", lambda x: x > 0)).cast("long").alias("n_quoted"), F.filter(F.transform("begins", passage), lambda p: p["norm"] != "").alias("passages"))


def first_said(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``window`` and ``origin``: the first turn that says a window itself."""
    short = F.filter(F.transform("own", normal), lambda x: (x != "") & (F.size(F.split(x, " ")) < WINDOW))
    parts = F.concat(F.transform(F.filter("passages", lambda p: p["kind"] == 0), lambda p: p["norm"]), short)
    said = messages.select("conv_id", "turn", F.explode(parts).alias("norm")).withColumn("words", F.split("norm", " ")).select("conv_id", "turn", F.explode(windows("words")).alias("window"))
    return said.groupBy("conv_id", "window").agg(F.min("turn").alias("origin"))


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``mark``, ``reply_to``, ``n_linked`` (quoted passages with an origin) and ``n_verbatim`` (those that stand word for word in it) of messages that quote earlier ones."""
    placed = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    first = first_said(placed)
    quotes = placed.filter("n_quoted > 0").distinct().select("conv_id", "turn", "mark", F.explode(F.filter("passages", lambda p: p["kind"] > 0)).alias("p"))
    cut = quotes.select("conv_id", "turn", "mark", "p.place", F.col("p.kind").alias("level"), F.length("p.norm").alias("chars"), "p.norm").withColumn("words", F.split("norm", " ")).withColumn("all", windows("words")).drop("words")
    keyed = cut.withColumn("n", F.size("all")).withColumn("window", F.explode("all")).drop("all", "norm")
    met = keyed.join(first, ["conv_id", "window"]).filter("origin < turn")
    passage = ["conv_id", "turn", "mark", "place"]
    votes = met.groupBy(*passage, "level", "chars", "n", "origin").agg(F.count("*").alias("votes")).filter("2 * votes >= n")
    owner = votes.groupBy(*passage, "level", "chars").agg(F.max(F.struct("votes", "origin"))["origin"].alias("origin"))
    # what the origin says itself, as one run of words
    own = placed.select("conv_id", F.col("turn").alias("origin"), F.array_join(F.transform(F.filter("passages", lambda p: p["kind"] == 0), lambda p: p["norm"]), " ").alias("said"))
    verbatim = F.contains(F.concat(F.lit(" "), F.col("said"), F.lit(" ")), F.concat(F.lit(" "), F.col("norm"), F.lit(" ")))
    stands = owner.join(cut.select(*passage, "norm"), passage).join(own, ["conv_id", "origin"], "left").groupBy(*passage).agg(F.max(F.coalesce(verbatim, F.lit(False)).cast("long")).alias("verbatim"))
    owner = owner.join(stands, passage)
    best = F.max(F.struct((-F.col("level")).alias("level"), "chars", "origin")).alias("best")
    per_origin = owner.groupBy("conv_id", "turn", "mark", "origin").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"), F.count("*").alias("passages"), F.sum("verbatim").alias("verbatim"))
    return per_origin.groupBy("conv_id", "turn", "mark").agg(best, F.sum("passages").alias("n_linked"), F.sum("verbatim").alias("n_verbatim")).select("conv_id", "turn", "mark", F.col("best.origin").alias("reply_to"), "n_linked", "n_verbatim")


def rounds(state: DataFrame, step, going: str, kind: str) -> DataFrame:
    """``step`` over the written ``state`` until no row says ``going``; each round's table replaces the one before."""
    spark, path = state.sparkSession, new_dir(state.sparkSession, kind)
    at = written_at(state, path)
    while not at.filter(going).isEmpty():
        after = new_dir(spark, kind)
        at = written_at(step(at), after)
        discard(spark, path)
        path = after
    return at


def thread_roots(links: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``thread_root`` and ``depth`` of each turn with a link, by pointer jumping."""

    def step(at: DataFrame) -> DataFrame:
        up = at.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("above"), F.col("depth").alias("more"))
        met = at.join(up, ["conv_id", "thread_root"], "left")
        return met.select("conv_id", "turn", F.coalesce("above", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))

    first = links.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread_root")).withColumns({"depth": F.lit(1).cast("long"), "moved": F.lit(True)})
    return rounds(first, step, "moved", "threads").drop("moved")


def positions(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and ``position`` (0 for the root) of the turns of threads, in reply order."""
    parents = links.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("parent"))
    beside = F.lead("turn").over(Window.partitionBy("conv_id", "parent").orderBy("turn"))
    tops = roots.select("conv_id", F.col("thread_root").alias("turn")).distinct()
    none = F.lit(None).cast("long")
    nodes = parents.withColumn("beside", beside).unionByName(tops.withColumns({"parent": none, "beside": none}))

    # where the nearest message above or at a node goes on; ``via`` is where that is still looked for
    def climb(at: DataFrame) -> DataFrame:
        up = at.select("conv_id", F.col("turn").alias("via"), F.col("on").alias("their_on"), F.col("via").alias("their_via"))
        return at.join(up, ["conv_id", "via"], "left").select("conv_id", "turn", F.coalesce("on", "their_on").alias("on"), F.when(F.coalesce("on", "their_on").isNull(), F.col("their_via")).alias("via"))

    onward = rounds(nodes.select("conv_id", "turn", F.col("beside").alias("on"), F.when(F.col("beside").isNull(), F.col("parent")).alias("via")), climb, "via IS NOT NULL", "onward")
    replies = parents.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("reply"))
    listed = onward.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("reply", "on").alias("then"))

    def rank(at: DataFrame) -> DataFrame:
        beyond = at.select("conv_id", F.col("turn").alias("then"), F.col("then").alias("their_then"), F.col("left").alias("more"))
        return at.join(beyond, ["conv_id", "then"], "left").select("conv_id", "turn", F.col("their_then").alias("then"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))

    ranked = rounds(listed.withColumn("left", F.col("then").isNotNull().cast("long")), rank, "then IS NOT NULL", "order").drop("then")
    whole = roots.select("conv_id", "turn", "thread_root").unionByName(tops.withColumn("thread_root", F.col("turn")))
    last = ranked.select("conv_id", F.col("turn").alias("thread_root"), F.col("left").alias("all"))
    return ranked.join(whole, ["conv_id", "turn"]).join(last, ["conv_id", "thread_root"]).select("conv_id", "turn", (F.col("all") - F.col("left")).alias("position"))


def link_quotes(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per message: conv_id, turn, role, reply_to, thread_root, depth, n_quoted, n_linked, n_verbatim, position, clean_text and formatted."""
    all_rows = rows_of(chats, conv_col, turn_col, role_col, text_col)
    quoting, others = all_rows.filter("quotes"), all_rows.filter("NOT quotes")
    marked = written(messages_of(quoting), "messages")
    told_to = marked.filter("n_quoted > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id").distinct()
    around = written(messages_of(others.join(told_to, "conv_id", "left_semi")), "messages")
    links = written(reply_links(marked.unionByName(around)), "replies")
    said = marked.select("conv_id", "turn", "mark", "role", "n_quoted", F.trim(F.array_join("own", "\n")).alias("clean_text"))
    rows = said.unionByName(others.select("conv_id", "turn", "mark", "role", F.lit(0).cast("long").alias("n_quoted"), F.trim("text").alias("clean_text")))
    roots = thread_roots(links)
    places = positions(links, roots)
    above = roots.select("conv_id", F.col("turn").alias("reply_to"), F.col("thread_root").alias("root_above"), F.col("depth").alias("depth_above"))
    threads = links.join(above, ["conv_id", "reply_to"], "left").select(
        "conv_id", "turn", "mark", "reply_to", "n_linked", "n_verbatim", F.coalesce("root_above", "reply_to").alias("thread_root"), (F.coalesce("depth_above", F.lit(0)) + 1).cast("long").alias("depth")
    ).join(places, ["conv_id", "turn"], "left")
    # what has no link is a root or alone: position 0
    told = rows.join(threads, ["conv_id", "turn", "mark"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("n_verbatim", F.lit(0)).cast("long").alias("n_verbatim"), F.coalesce("position", F.lit(0)).cast("long").alias("position"), "clean_text",
    )
    return chat_template(told)


def chat_template(threads: DataFrame) -> DataFrame:
    """``formatted``: the message in chat form; sort by conv_id, thread_root, position to read a conversation in reply order."""
    return threads.withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("clean_text"), F.lit("\n")))
