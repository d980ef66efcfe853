"""Chat formatting into budgeted windows.

A conversation's turns are marked by a template, its control strings inside the
texts are escaped reversibly, and the turns are dealt into windows: a window is
a span of whole turns whose tokens fit a budget. Each window repeats the
conversation's first system turn and, at most, a limited number of the turns
before its span; what it repeats is masked, so every target is learned once.

A window's tokens (white-space words, the marks included) are those of its own
turns and of all that it repeats. A span begins with a turn that no longer fits;
turns before it are repeated, the nearest first, as far as they fit beside the
system turn and that turn. Only a turn that is too long beside the system turn
exceeds the budget; its window holds these two and nothing else.

Template: ``<s>[SYS] text [/SYS]</s>``, ``<s>[INST] text [/INST]</s>`` (user),
``<s>[ANS] text [/ANS]</s>`` (assistant) and ``<s>[ROLE:name] text [/ROLE]</s>``
for other roles. Escape: in texts and role names ``\\``, ``[``, ``]`` and ``<`` get a
``\\`` before them, so no unescaped control string can stand in a text.

A null text is empty, a null role is "unknown", a null turn sorts first, turns
with equal numbers are ordered by role and text, and repeated rows are turns of
their own. Rows of a null conversation form one conversation. Texts and role
names of any length are read back whole. An empty table gives no windows. Extra
columns are not read, whatever their names. A conversation is ordered in one task
(its sort spills); besides 24 bytes a turn for the fold, no row holds more than a
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statwright.llm.common import SPACE

#: Tokens (whitespace words and marks) of a window, and turns of repeated history.
BUDGET, HISTORY = 1024, 2
HEADS = {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[ANS] "}
TAILS = {"system": " [/SYS]</s>", "user": " [/INST]</s>", "assistant": " [/ANS]</s>"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marked(role: Column, text: Column) -> Column:
    head = F.concat(F.lit("<s>[ROLE:"), escape(role), F.lit("] "))
    tail = F.lit(" [/ROLE]</s>")
    for r in HEADS:
        head = F.when(role == r, HEADS[r]).otherwise(head)
        tail = F.when(role == r, TAILS[r]).otherwise(tail)
    return F.concat(head, escape(text), tail)


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with nulls replaced as the module says."""
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def placed(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Each turn with its position, formatted text, tokens, span (the number of its own window) and, on a span's first turn, reach (the turns before it that are repeated).

    The fold over a conversation's tokens keeps the first turns of spans; ``begun``
    is what a window would hold that begins with a turn. A window's tokens at a
    later turn are ``begun`` and the difference of two prefix sums.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    by_pos, whole = Window.partitionBy("conv_id").orderBy("pos"), Window.partitionBy("conv_id")
    marked = turns.withColumn("formatted", _marked(F.col("role"), F.col("text")))
    at = marked.withColumn("tokens", F.size(F.split("formatted", SPACE)).cast("long")).withColumn("pos", F.row_number().over(order).cast("long")).drop("turn", "text")
    known = (
        at.withColumn("system", F.min(F.when(F.col("role") == "system", F.struct("pos", "tokens"))).over(whole))
        .withColumn("upto", F.sum("tokens").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("base", F.col("tokens") + F.when(F.col("system.pos") < F.col("pos"), F.col("system.tokens")).otherwise(0))
    )
    own = F.when(F.col("pos") == F.col("system.pos"), 0).otherwise(F.col("tokens"))
    reach, begun, total = F.lit(0), F.col("base"), F.col("base")
    for k in range(1, history + 1):
        total = total + F.coalesce(F.lag(own, k).over(by_pos), F.lit(0))
        reach, begun = F.when(total <= budget, k).otherwise(reach), F.when(total <= budget, total).otherwise(begun)
    known = known.withColumn("begun", begun).withColumn("reach", reach)
    # room: the prefix sum up to which the open window has place
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct("pos", "upto", "begun"))), F.struct(F.lit(-1).cast("long").alias("room"), F.array().cast("array<bigint>").alias("starts")),
        lambda a, t: F.when(t["upto"] > a["room"], F.struct((t["upto"] - t["begun"] + budget).alias("room"), F.concat(a["starts"], F.array(t["pos"])).alias("starts"))).otherwise(a),
        lambda a: a["starts"],
    )
    starts = known.groupBy("conv_id").agg(fold.alias("starts")).select(F.col("conv_id").alias("of"), F.posexplode("starts").alias("number", "start"))
    joined = known.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("start")), "left")
    return (
        joined.withColumn("span", F.max("number").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
        .withColumn("reach", F.when(F.col("start").isNotNull(), F.col("reach")))
        .select("conv_id", "pos", "role", "formatted", "tokens", "span", "reach", (F.col("pos") == F.col("system.pos")).alias("first_system"))
    )


def segments(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, **columns: str) -> DataFrame:
    """(conv_id, window, pos, role, formatted, own, loss): the turns that each window holds, a row a turn and window.

    own marks the turns of the window's span, which each turn is once; loss marks the
    assistant turns of these. A turn is repeated in the windows whose span begins at
    most ``history`` turns after it and reaches back to it, which looking that far
    ahead tells; the system turn is repeated in all windows after its own.
    """
    at = placed(turns_of(conversations, **columns), budget, history)
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    none = F.array().cast("array<bigint>")
    ahead = F.array_compact(F.array(*[F.lead(F.when(F.col("reach") >= k, F.col("span")), k).over(by_pos) for k in range(1, history + 1)])) if history else none
    last = F.max("span").over(Window.partitionBy("conv_id"))
    rows = at.withColumn("ahead", ahead).withColumn("last", last)
    later = F.when(F.col("first_system"), F.when(F.col("last") > F.col("span"), F.sequence(F.col("span") + 1, F.col("last"))).otherwise(none)).otherwise(F.col("ahead"))
    held = F.concat(F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("own"))), F.transform(later, lambda w: F.struct(w.alias("window"), F.lit(False).alias("own"))))
    return rows.select("conv_id", "pos", "role", "formatted", F.inline(held)).select("conv_id", "window", "pos", "role", "formatted", "own", (F.col("own") & (F.col("role") == "assistant")).alias("loss"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, **columns: str) -> DataFrame:
    """(conv_id, window, segments, formatted): each window as text, with the loss mask as segments (pos, role, start, chars, own, loss)."""
    lists = segments(conversations, budget, history, **columns).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "formatted", "own", "loss"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["formatted"]), "")
    marks = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:bigint,role:string,start:int,chars:int,own:boolean,loss:boolean>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["formatted"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(p["pos"].alias("pos"), p["role"].alias("role"), a["at"].alias("start"), F.length(p["formatted"]).alias("chars"), p["own"].alias("own"), p["loss"].alias("loss")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return lists.select("conv_id", "window", marks.alias("segments"), text.alias("formatted"))


#: A turn as the template writes it: its head, the escaped text and its tail. Its loops are possessive, which the JVM
#: matches without recursion; a segment holds one turn, so the text goes to the last tail.
TURN = r"(?s)^<s>\[(SYS|INST|ANS|ROLE:[^\\\]]*+(?:\\.[^\\\]]*+)*+)\] (.*) \[/(?:SYS|INST|ANS|ROLE)\]</s>$"


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, pos, role, text, own, loss, chars) parsed from the windows' text, a row a segment."""
    part = F.expr("substring(formatted, seg.start + 1, seg.chars)")
    head = F.regexp_extract("part", TURN, 1)
    named = F.when(head == "SYS", "system").when(head == "INST", "user").when(head == "ANS", "assistant").otherwise(unescape(F.regexp_replace(head, "^ROLE:", "")))
    return (
        formatted.select("conv_id", "window", "formatted", F.explode("segments").alias("seg"))
        .select("conv_id", "window", "seg.pos", "seg.own", "seg.loss", part.alias("part"))
        .select("conv_id", "window", "pos", named.alias("role"), unescape(F.regexp_extract("part", TURN, 2)).alias("text"), "own", "loss", F.length("part").alias("chars"))
    )
