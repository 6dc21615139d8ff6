r"""Reply trees as training conversations; DataFrame functions only.

Messages (tree_id, message_id, parent_id, role, text, score) reply to one another; every path from a root to a leaf is a possible
conversation.

1. *Paths.*  Self-joins by pointer doubling: after round r a message knows its ancestor 2**r steps up, and the sum and number of the scores
   on the way, so a path of n messages takes log2(n) rounds.  Only trees with unfinished messages go on to the next round.
2. *Rank.*  A branch scores the mean of its messages' scores.  The best ``branches`` leaves of every tree are chosen, ties to the smaller leaf;
   the limit applies before the shuffle.
3. *Enumerate.*  The chosen leaves walk up the stored pointers, largest step first: every round splits a stretch of a path in two, so no path
   is joined message by message.
4. *Format.*  ``<|im_start|>role<|im_sep|>text<|im_end|>`` for every message.  In roles and texts a ``<``, any backslashes and a ``|`` get one more
   backslash, so that no control string can stand in them; taking one away gives the text back.  ``loss`` names the stretches of the
   assistants' texts.

Nulls: a null role or text is empty, a null score (or one that is not a number) is 0, a null ``parent_id`` or one that is no message of the tree makes a root;
rows without a tree or message id are in no tree and left out.  Rows that repeat a message id are one message, with the smallest parent,
score, role and text.  Messages in or under a circle of replies have no root and are on no path.  An empty table gives an
empty result.  Extra columns are ignored by name.  A formatted conversation is one string, so it has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.session import stage

#: Marks of the template (fixed values).
START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rooted(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((tree_id, message_id, parent_id, total, size) of every message with a root, [(tree_id, message_id, up) by round]).

    ``total`` and ``size`` are the scores' sum and the number of messages from the root on; ``up`` is the ancestor 2**round steps up.
    """
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    own = messages.where("tree_id IS NOT NULL AND message_id IS NOT NULL").groupBy("tree_id", "message_id").agg(
        F.min(F.struct("parent_id", score.alias("score"))).alias("m")).select("tree_id", "message_id", "m.*")
    own = stage(own, "messages")
    above = own.select("tree_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("there"))
    live = stage(own.join(above, ["tree_id", "parent_id"], "left").select(
        "tree_id", "message_id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"),
        F.when(F.col("there"), F.col("parent_id")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("size")), "paths")
    done, levels, before = live.where("up IS NULL"), [], -1
    while True:
        open_ = live.where("up IS NOT NULL")
        left = open_.count()
        if left in (0, before):  # a round that finishes nothing leaves circles only
            return done.drop("up"), levels
        before = left
        levels.append(open_.select("tree_id", "message_id", "up"))
        ahead = live.select("tree_id", F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("total").alias("t"), F.col("size").alias("s"))
        moved = open_.join(ahead, ["tree_id", "up"]).select(
            "tree_id", "message_id", "parent_id", F.col("next").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("size") + F.col("s")).alias("size"))
        moved = stage(moved, "paths")
        done = done.unionByName(moved.where("up IS NULL"))
        going = moved.where("up IS NOT NULL").select("tree_id").distinct()
        live = stage(moved.unionByName(live.where("up IS NULL")).join(going, "tree_id", "left_semi"), "live")


def branches_of(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf_id, branch, score, message_id, position) of the messages of the chosen paths; positions count from 0 at the root."""
    done, levels = rooted(messages)
    replied = done.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("message_id"))
    leaves = done.join(replied, ["tree_id", "message_id"], "left_anti").select(
        "tree_id", F.col("message_id").alias("leaf_id"), (F.col("total") / F.col("size")).alias("score"), "size")
    order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    leaves = leaves.withColumn("branch", F.row_number().over(order))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    steps = leaves.select("tree_id", "leaf_id", "branch", "score", F.col("leaf_id").alias("message_id"), (F.col("size") - 1).alias("position"), F.col("size").alias("count"))
    for r in reversed(range(len(levels))):
        step = 1 << r
        up = levels[r].select(F.col("tree_id").alias("_tree"), F.col("message_id").alias("_message"), "up")
        lower = F.struct("message_id", "position", F.least("count", F.lit(step).cast("long")).alias("count"))
        upper = F.struct(F.col("up").alias("message_id"), (F.col("position") - step).alias("position"), (F.col("count") - step).alias("count"))
        met = (F.col("tree_id") == F.col("_tree")) & (F.col("message_id") == F.col("_message")) & (F.col("count") > step)
        parts = F.explode(F.when(F.col("up").isNull(), F.array(lower)).otherwise(F.array(lower, upper)))
        steps = steps.join(up, met, "left").select("tree_id", "leaf_id", "branch", "score", parts.alias("part")).select(
            "tree_id", "leaf_id", "branch", "score", "part.*")
    return steps.drop("count")


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf_id, branch, score, n_turns, formatted, loss) of the best ``branches`` paths of every tree (None: of all).

    ``loss``: for every assistant's text the number of its turn, ``at`` and ``length`` in code points from the start of that turn's mark, and
    ``start`` from the start of the conversation.
    """
    empty = F.lit("")
    texts = messages.where("tree_id IS NOT NULL AND message_id IS NOT NULL").select(
        "tree_id", "message_id", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    path = ["tree_id", "leaf_id"]
    turns = branches_of(messages, branches).join(texts, ["tree_id", "message_id"]).repartition(*path)
    repeated = F.row_number().over(Window.partitionBy(*path, "position").orderBy("role", "text"))
    turns = turns.withColumn("_nth", repeated).where("_nth = 1")
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(BREAK)), escape(F.col("text"))
    turns = turns.select(*path, "branch", "score", "position", (F.col("role") == TRAINED).alias("trained"), F.length(head).alias("at"),
                         F.length(body).alias("length"), F.concat(head, body, F.lit(END)).alias("turn"))
    before = Window.partitionBy(*path).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    whole = turns.groupBy(*path, "branch", "score").agg(F.array_sort(F.collect_list(F.struct("position", "turn", "trained", "at", "length", "before"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(
        t["position"].cast("int").alias("turn"), t["at"].alias("at"), t["length"].alias("length"), (t["before"] + t["at"]).alias("start")))
    return whole.select(*path, "branch", "score", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def _segments() -> Column:
    """What follows each start mark of ``formatted``."""
    return F.filter(F.split("formatted", START.replace("|", r"\|")), lambda _, i: i > 0)


def turns() -> Column:
    """The messages of a conversation read back from ``formatted``, as an array of (role, text)."""
    return F.transform(_segments(), lambda s: F.struct(
        unescape(F.substring_index(s, BREAK, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, BREAK, -1), END, 1)).alias("text")))


def trained_text() -> Column:
    """All text under the loss mask, read back from ``formatted`` and ``loss``."""
    return F.array_join(F.transform(F.arrays_zip("loss", F.transform("loss", lambda t: F.get(F.col("_segments"), t["turn"])).alias("s")), lambda z: unescape(
        F.substr(z["s"], z["loss"]["at"] - len(START) + 1, z["loss"]["length"]))), "")


def read_back(conversations: DataFrame) -> DataFrame:
    """``conversations`` with ``turns`` and ``trained``, both parsed from the formatted strings."""
    return conversations.withColumn("_segments", _segments()).select(*conversations.columns, turns().alias("turns"), trained_text().alias("trained"))


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: every row replies to the one before it.

    Rows without a conversation id are one conversation, with the tree id ''.  Order: turn (null first), role, text.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree_id"), "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select("tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
