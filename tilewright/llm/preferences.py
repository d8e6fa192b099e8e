"""Preference formatting: one prompt from the common turns of two conversations, and two completions with loss masks.

The longest common prefix of turns (equal role and text) is rendered once as the
prompt; what follows in the chosen and the rejected conversation are the
completions.  Masks are spans (code points of prompt plus completion) of the
assistant's words in the completion; nothing in the prompt is trained on.

Defined results: null turn numbers come last, turns with equal numbers are ordered
by role and text, null roles are ``unknown`` and null texts empty; rows without a
conv_id form one conversation; equal conversations give empty completions with
status ``equal``; without a partner or without a reply there is no rejected side.
Repeated turns are rendered as often as they stand there; an empty table gives an empty one; a very long text is one
turn of its row; columns other than conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import in_batches

# The template of a turn.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role: string, text: string>>"


def rendered(turns: list[dict], start: int = 0) -> tuple[str, list[dict]]:
    """Text of turns and the spans of the assistant's words with their closing mark, counted from ``start``."""
    parts, spans = [], []
    for turn in turns:
        head = f"{OPEN}{turn['role']}{AFTER_ROLE}"
        body = f"{turn['text']}{CLOSE}"
        if turn["role"] == "assistant":
            spans.append({"start": start + len(head), "end": start + len(head) + len(body)})
        parts += [head, body]
        start += len(head) + len(body)
    return "".join(parts), spans


def preference(chosen: list[dict] | None, rejected: list[dict] | None) -> dict:
    """Prompt, completions, masks and status of one pair of turn lists."""
    if not chosen or not rejected:
        prompt, _ = rendered(chosen or [])
        return {"n_common": len(chosen or []), "prompt": prompt, "chosen": "", "rejected": "", "chosen_mask": [], "rejected_mask": [], "status": "single"}
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    prompt, _ = rendered(chosen[:n])
    good, good_mask = rendered(chosen[n:], len(prompt))
    bad, bad_mask = rendered(rejected[n:], len(prompt))
    status = "equal" if not good and not bad else "pair" if good_mask and bad_mask else "untrained"
    return {"n_common": n, "prompt": prompt, "chosen": good, "rejected": bad, "chosen_mask": good_mask, "rejected_mask": bad_mask, "status": status}


SPANS = "array<struct<start: int, end: int>>"
NAMES = ("n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "status")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair (conv_id, rejected_id, chosen, rejected as arrays of role and text)."""
    def work(rows):
        found = [preference(c, r) for c, r in zip(rows["chosen"], rows["rejected"])]
        return {"conv_id": rows["conv_id"], "rejected_id": rows["rejected_id"]} | {n: [f[n] for f in found] for n in NAMES}

    schema = (
        f"conv_id long, rejected_id long, n_common int, prompt string, chosen string, rejected string, chosen_mask {SPANS}, rejected_mask {SPANS}, status string")
    return in_batches(pairs.select("conv_id", "rejected_id", "chosen", "rejected"), work, schema)


def assembled(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered turns; a conversation is one training sample and has to fit a row."""
    order = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("at"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(order))
    return turns.groupBy("conv_id").agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _last_reply(turns: Column) -> Column:
    """Number (from 1) of the assistant's last turn, 0 without one."""
    marked = F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    return F.coalesce(F.array_max(marked), F.lit(0))


def _lonely(talks: DataFrame, me: Column) -> DataFrame:
    """The conversations without a neighbour, with an ``other`` from outside of their group where there is one."""
    alone = talks.where(F.col("other").isNull()).drop("other")
    order = F.struct((F.col("reply") == 0).alias("mute"), F.col("conv_id").isNotNull().alias("named"), "conv_id")
    ends = [F.min_by(me, order), F.max_by(me, order)]
    for_opening = talks.where("hot").groupBy("opening").agg(ends[0].alias("low"), ends[1].alias("high"))
    for_all = talks.agg(ends[0].alias("first"), ends[1].alias("last"))
    met = alone.join(for_opening, "opening", "left").crossJoin(for_all)
    apart = [F.when(~F.col(f"{x}.conv_id").eqNullSafe(F.col("conv_id")), F.col(x)) for x in ("low", "high", "first", "last")]
    return met.withColumn("other", F.coalesce(*apart)).drop("low", "high", "first", "last")


def contrasted(turns: DataFrame, per_group: int = 10_000) -> DataFrame:
    """Preference pairs from plain conversations: conv_id, rejected_id, chosen, rejected.

    Conversations are dealt into groups of about ``per_group`` by a hash of their first turn and ordered there by it,
    so equal first turns meet whatever the size; only a first turn that fills a large part of a group is cut further,
    by a hash of conv_id, into groups of its own.  A neighbour with the same first turn contrasts as it is; a
    conversation whose first turn occurs once takes the neighbour's last reply in place of the own one.  One that is
    alone in its group meets the first or last conversation with its first turn, else one of the whole table.
    """
    talks = assembled(turns).withColumns({"opening": F.xxhash64(F.get("turns", 0)), "reply": _last_reply(F.col("turns"))})
    groups = max(1, -(-turns.select("conv_id").distinct().count() // per_group))
    piece = max(1, per_group // 4)
    # Fewer than four openings a group can be large, so the broadcast has three numbers for each 2,500 conversations at most.
    large = talks.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
    large = F.broadcast(large.select("opening", F.ceil(F.col("n") / piece).alias("pieces")))
    talks = talks.join(large, "opening", "left")
    hot = F.col("pieces").isNotNull()
    talks = talks.withColumns({
        "group": F.when(hot, F.col("opening")).otherwise(F.pmod("opening", F.lit(groups))), "hot": hot,
        "piece": F.when(hot, F.pmod(F.xxhash64("conv_id"), "pieces")).otherwise(0)}).drop("pieces")
    order = Window.partitionBy("hot", "group", "piece").orderBy("opening", "conv_id")
    me = F.struct("conv_id", "opening", "turns", "reply")
    before, after = F.lag(me).over(order), F.lead(me).over(order)
    talks = talks.withColumns({"before": before, "after": after})
    alike = [F.when(F.col(f"{side}.opening") == F.col("opening"), F.col(side)) for side in ("before", "after")]
    talks = talks.withColumn("other", F.coalesce(*alike, "before", "after")).drop("before", "after")
    talks = talks.where(F.col("other").isNotNull()).unionByName(_lonely(talks, me))

    same = F.col("other.opening") == F.col("opening")
    borrowed = F.get(F.col("other.turns"), F.col("other.reply") - 1)
    answered = (F.col("reply") > 0) & (F.col("other.reply") > 0)
    swapped = F.concat(F.slice("turns", 1, F.greatest(F.col("reply") - 1, F.lit(0))), F.array(borrowed))
    chosen = F.when(same | ~answered, F.col("turns")).otherwise(F.slice("turns", 1, F.col("reply")))
    rejected = F.when(same, F.col("other.turns")).when(answered, swapped)
    return talks.select("conv_id", F.when(same | answered, F.col("other.conv_id")).alias("rejected_id"), F.when(F.col("other").isNull(), F.col("turns")).otherwise(chosen).alias("chosen"), rejected.alias("rejected"))
