"""Preference formatting with DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of equal turns is
rendered once as the prompt; what is left of each is its completion, with a mask: the character
spans of the completion that carry loss (the assistant's turns, with their end marks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwright.llm.spark import table

#: Branches of a group that one task takes, about, and limits on the groups and salts that are above that.
HOT, MOST_HOT, MOST_SALTS = 256, 10_000, 4096
#: Conversations may lend each other a reply if their ids are equal without these low bits.
BUCKET_LOG2 = 6
_END = "<|end|>\n"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), _text(t["role"]), F.lit("|>\n"))


def _render(t: Column) -> Column:
    return F.concat(_head(t), _text(t["text"]), F.lit(_END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end of what carries loss, comma-joined."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(_head(t))
        end = begin + F.length(_text(t["text"])) + len(_END)
        span = F.concat(F.when(s["out"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(_text(t["role"]) == "assistant", F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, state, step, lambda s: s["out"])


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order of turn, role and text, nulls first. Rows with a null conv_id are left out."""
    turn = F.struct("turn", "role", "text")
    return df.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: any columns with ``chosen`` and ``rejected``, arrays of (turn, role, text).

    Gives those columns, with prompt, completions and masks in place of the arrays.  Null texts and roles render
    as empty, and turns are equal if they render alike.  Equal conversations: empty completions.
    """
    a, b = F.col("chosen"), F.col("rejected")
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (_text(x["role"]) == _text(y["role"])) & (_text(x["text"]) == _text(y["text"])))
    first = F.array_position(same, F.lit(False))  # 0: none
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    cut = pairs.withColumn("n_prefix", F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long"))
    rest = lambda c: F.slice(c, F.col("n_prefix").cast("int") + 1, F.greatest(F.size(c) - F.col("n_prefix").cast("int"), F.lit(0)))
    cut = cut.select(*keep, "n_prefix", F.slice(a, 1, F.col("n_prefix").cast("int")).alias("head"), rest(a).alias("rest_a"), rest(b).alias("rest_b"))
    return cut.select(*keep, "n_prefix", _rendered(F.col("head")).alias("prompt"), _rendered(F.col("rest_a")).alias("chosen"), _rendered(F.col("rest_b")).alias("rejected"), _mask(F.col("rest_a")).alias("chosen_mask"), _mask(F.col("rest_b")).alias("rejected_mask"))


def reply_place(turns: Column) -> Column:
    """Place (from 1) of the assistant's last turn; 0 if there is none."""
    back = F.array_position(F.reverse(F.transform(turns, lambda t: _text(t["role"]) == "assistant")), F.lit(True))
    return F.when(back == 0, F.lit(0)).otherwise(F.size(turns) - back + 1).cast("int")


def _first_key(turns: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(turns[0]["role"], F.lit("\x01")), F.coalesce(turns[0]["text"], F.lit("\x01"))), 256)


def branch_pairs(df: DataFrame) -> DataFrame:
    """Pairs from a table of conversations (conv_id, turn, role, text) without preferences.

    ``branch``: conversations with the same first turn are branches of one dialogue; the one with the smallest id is
    chosen, and each other is rejected against it, however many there are.  Branches that render like the chosen one
    are no pair.  Groups of more than HOT members (and one in MOST_HOT of the conversations) are salted;
    there are fewer than MOST_HOT of them, so their keys may be broadcast.

    ``swapped``: a conversation alone is chosen, and its like with another's last reply is rejected: that of the next
    conversation by id (the first, after the last) among those alone with an assistant's turn whose ids agree
    but for BUCKET_LOG2 low bits.  No reply, nobody else there, or the same reply: no pair.
    """
    convs = conversations(df)
    keys = convs.select("conv_id", _first_key(F.col("turns")).alias("first"))
    groups = keys.groupBy("first").agg(F.min("conv_id").alias("head_id"), F.count("*").alias("n"))
    least = max(HOT, -(-df.count() // MOST_HOT))
    branched = groups.filter(F.col("n") > 1).withColumn("salts", F.when(F.col("n") > least, F.least(F.ceil(F.col("n") / HOT), F.lit(MOST_SALTS))).otherwise(1).cast("int"))
    marked = keys.join(F.broadcast(branched.filter(F.col("n") > least).select("first", "head_id", "salts")), "first", "left")
    hot = marked.filter(F.col("head_id").isNotNull()).select("conv_id", "head_id", F.pmod(F.hash("conv_id"), F.col("salts")).alias("salt"))
    few = marked.filter(F.col("head_id").isNull()).select("conv_id", "first").join(branched.filter(F.col("n") <= least).select("first", "head_id"), "first")
    members = hot.unionByName(few.select("conv_id", "head_id", F.lit(0).alias("salt"))).filter(F.col("conv_id") != F.col("head_id"))
    heads = branched.select("head_id", "salts").join(convs.select(F.col("conv_id").alias("head_id"), F.col("turns").alias("chosen")), "head_id")
    heads = heads.select("head_id", "chosen", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = convs.join(members, "conv_id").join(heads, ["head_id", "salt"]).filter(_turns(F.col("turns")) != _turns(F.col("chosen")))
    pairs = pairs.select(F.lit("branch").alias("kind"), F.col("head_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))

    lone = groups.filter(F.col("n") == 1).select(F.col("head_id").alias("conv_id"))  # its smallest id is its only one
    alone = convs.join(lone, "conv_id").select("conv_id", "turns", reply_place(F.col("turns")).alias("place")).filter(F.col("place") > 0)
    alone = alone.withColumn("reply", F.element_at("turns", F.col("place"))["text"])
    bucket = W.partitionBy(F.shiftright("conv_id", BUCKET_LOG2)).orderBy("conv_id")
    other = F.struct("conv_id", "reply")
    alone = alone.withColumn("other", F.coalesce(F.lead(other).over(bucket), F.first(other).over(bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    swap = F.transform(F.slice("turns", 1, F.col("place")), lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("place") - 1, F.col("other.reply")).otherwise(t["text"]).alias("text")))
    swapped = alone.filter((F.col("other.conv_id") != F.col("conv_id")) & ~_text(F.col("reply")).eqNullSafe(_text(F.col("other.reply"))))
    return pairs.unionByName(swapped.select(F.lit("swapped").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("other.conv_id").alias("rejected_id"), F.slice("turns", 1, F.col("place")).alias("chosen"), swap.alias("rejected")))


def _turns(turns: Column) -> Column:
    """Roles and texts, to compare conversations by."""
    return F.transform(turns, lambda t: F.struct(_text(t["role"]).alias("role"), _text(t["text"]).alias("text")))


def op9_preference_chat(spark, sf_dir: str) -> DataFrame:
    return format_pairs(branch_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The same rows in DuckDB's SQL: the prefix by a join of turns, spans by running sums.
ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT role, text, min(conv_id) AS head, count(*) AS n FROM t WHERE i = 1 GROUP BY role, text),
f AS (SELECT t.conv_id, head, n FROM t JOIN heads h ON t.role IS NOT DISTINCT FROM h.role AND t.text IS NOT DISTINCT FROM h.text WHERE i = 1),
lone AS (SELECT conv_id, max(i) AS place FROM t JOIN f USING (conv_id) WHERE n = 1 AND role = 'assistant' GROUP BY conv_id),
nx AS (
  SELECT conv_id, place, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS other
  FROM lone WINDOW w AS (PARTITION BY conv_id // 64 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sw AS (
  SELECT nx.conv_id, nx.place, nx.other, b.text AS reply FROM nx
  JOIN t a ON a.conv_id = nx.conv_id AND a.i = nx.place
  JOIN lone o ON o.conv_id = nx.other JOIN t b ON b.conv_id = o.conv_id AND b.i = o.place
  WHERE nx.other <> nx.conv_id AND coalesce(a.text, '') <> coalesce(b.text, '')),
p0 AS (
  SELECT 'branch' AS kind, head AS chosen_id, conv_id AS rejected_id FROM f WHERE n > 1 AND conv_id <> head
  UNION ALL SELECT 'swapped', conv_id, other FROM sw),
c AS (
  SELECT p0.*, t.i, t.role, t.text FROM p0 JOIN t ON t.conv_id = p0.chosen_id LEFT JOIN sw ON kind = 'swapped' AND sw.conv_id = p0.chosen_id
  WHERE sw.place IS NULL OR t.i <= sw.place),
r AS (
  SELECT p0.*, t.i, t.role, t.text FROM p0 JOIN t ON kind = 'branch' AND t.conv_id = p0.rejected_id
  UNION ALL SELECT c.kind, c.chosen_id, c.rejected_id, c.i, c.role, CASE WHEN c.i = sw.place THEN sw.reply ELSE c.text END
  FROM c JOIN sw ON c.kind = 'swapped' AND sw.conv_id = c.chosen_id),
cut AS (
  SELECT coalesce(c.kind, r.kind) AS kind, coalesce(c.chosen_id, r.chosen_id) AS chosen_id, coalesce(c.rejected_id, r.rejected_id) AS rejected_id,
    min(CASE WHEN c.i IS NULL OR r.i IS NULL OR coalesce(c.role, '') <> coalesce(r.role, '') OR coalesce(c.text, '') <> coalesce(r.text, '') THEN coalesce(c.i, r.i) END) - 1 AS n
  FROM c FULL JOIN r ON c.kind = r.kind AND c.chosen_id = r.chosen_id AND c.rejected_id = r.rejected_id AND c.i = r.i GROUP BY 1, 2, 3),
turns AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
s AS (
  SELECT side, kind, chosen_id, rejected_id, i, coalesce(role, '') AS role, n, i <= n AS shared,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS seg, length(coalesce(role, '')) + 5 AS head
  FROM turns JOIN cut USING (kind, chosen_id, rejected_id) WHERE n IS NOT NULL),
m AS (SELECT *, sum(length(seg)) OVER (PARTITION BY side, kind, chosen_id, rejected_id, shared ORDER BY i) AS fin FROM s)
SELECT kind, chosen_id, rejected_id, any_value(n) AS n_prefix,
  coalesce(string_agg(seg, '' ORDER BY i) FILTER (shared AND side = 'c'), '') AS prompt,
  coalesce(string_agg(seg, '' ORDER BY i) FILTER (NOT shared AND side = 'c'), '') AS chosen,
  coalesce(string_agg(seg, '' ORDER BY i) FILTER (NOT shared AND side = 'r'), '') AS rejected,
  coalesce(string_agg((fin - length(seg) + head)::BIGINT || ':' || fin::BIGINT, ',' ORDER BY i) FILTER (NOT shared AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((fin - length(seg) + head)::BIGINT || ':' || fin::BIGINT, ',' ORDER BY i) FILTER (NOT shared AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY kind, chosen_id, rejected_id
"""
