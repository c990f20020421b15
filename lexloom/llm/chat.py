"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens choose the windows: turns are taken into a window as long as all of it fits into BUDGET. A
window starts with the system turn that leads the conversation, then repeats the turns before it whose tokens, by their
prefix sums, fit into HISTORY, then has its own turns. Both count in the budget. Only a window's own assistant turns are
under its loss mask, so that each of them is learned once.

No window of several turns of its own exceeds BUDGET. A turn that does not fit beside the system turn and the history goes
without history; one that does not even fit beside the system turn alone is a window of its own with it, the only kind
that is longer. A leading system turn of more than LEAD tokens is a turn like others and is not repeated.

A turn is written as "### role:\\ntext</turn>\\n". Inside roles and texts the backslash, "#", "<" (and in roles ":" and the
line end) are escaped with a backslash and a letter, so that no text can hold a mark, and reading back is exact.

A conversation is cut into blocks of BLOCK turn numbers, and a window ends where its block does; system turn and history
go on across that border. So texts are shuffled once to their blocks, where all windows are made inside one row, and once
more to the digests; of a long conversation only the leading system turn and each block's last few turns are sent twice. The
digest of a whole conversation is by its nature one row.

Tokens are estimated: one for LETTERS letters of the text, and OVERHEAD a turn.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; null turn comes before all
others; equal turn numbers are ordered by role, then text, and repeated rows stay; a conversation without assistant
turns has no loss; an empty table gives the sample conversation of the query alone; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import small, table

BUDGET, HISTORY, LEAD, OVERHEAD, LETTERS, BLOCK = 2048, 256, 512, 8, 4, 64  # tokens of a window, its history and its system turn at most; tokens added a turn, letters a token; turn numbers of a block
TEXT_MARKS = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l")]  # the backslash first; read back in reverse
ROLE_MARKS = [*TEXT_MARKS, (":", "\\c"), ("\n", "\\n")]
SAMPLE = "\\### Assistant: </turn> ok"
BORDER, LEADING, PAST, OWN = range(4)  # kinds of rows of a block: that it is not the first, the system turn, history, turns of its own


def escaped(c: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, code in marks:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, code in reversed(marks):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def tokens(text: Column | str) -> Column:
    return F.floor(F.length(text) / LETTERS) + OVERHEAD


def with_blocks(turns: DataFrame) -> DataFrame:
    return turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 60))) / BLOCK))


def carried(t: DataFrame, history: int, lead: int) -> DataFrame:
    """conv_id, block, kind, turn, role, text: what the blocks after a conversation's first one hold beside their own turns. All but
    the last step look at numbers only, and at conversations of several blocks."""
    blocks = t.groupBy("conv_id", "block").agg(F.min(F.struct("turn", "role")).alias("first"))
    blocks = blocks.withColumn("next", F.lead("block").over(Window.partitionBy("conv_id").orderBy("block")))
    several = blocks.groupBy("conv_id").agg(F.min("block").alias("_block"), F.min("first").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    several = several.select(F.col("conv_id").alias("_conv"), "_block", F.col("_first.turn").alias("_turn"), (F.col("_first.role") == "system").alias("_led"))
    several = small(t.sparkSession, several, "long-talks")  # so that no text is shuffled to find out that its conversation is short
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    later = blocks.join(several, same & (F.col("block") != F.col("_block"))).select("conv_id", "block", "_led")
    border = later.select("conv_id", "block", F.lit(BORDER).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    text = t.where("role = 'system'").join(several.where("_led"), same & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("block") == F.col("_block"))).groupBy("_conv", "_turn").agg(F.min("text").alias("text"))
    text = text.where(tokens("text") <= lead)
    leading = later.join(text, same).select("conv_id", "block", F.lit(LEADING).alias("kind"), F.col("_turn").alias("turn"), F.lit("system").alias("role"), "text")
    first = F.col("_led") & (F.col("block") == F.col("_block")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == "system")
    past = t.where("turn is not null").join(several, same).where(~first)
    sums = past.groupBy("conv_id", "block", "turn").agg(F.sum(tokens("text")).alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").desc())))
    tails = sums.where(F.col("upto") <= history).groupBy("conv_id", "block").agg(F.min("turn").alias("_from"))
    tails = tails.join(blocks.where("next is not null").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "next"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    tails = small(t.sparkSession, tails.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "_from", "next"), "tails")
    past = past.join(tails, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("turn") >= F.col("_from")))
    past = past.select("conv_id", F.col("next").alias("block"), F.lit(PAST).alias("kind"), "turn", "role", "text")
    return border.unionByName(leading).unionByName(past)


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, lead: int = LEAD) -> DataFrame:
    """turns (conv_id, turn, role, text) to a row a window: conv_id, block, window, formatted, tokens, n_own, n_repeated (turns at its
    start that other windows hold as their own), loss (array of start and length in code points of formatted)."""
    t = with_blocks(turns)
    both = t.withColumn("kind", F.lit(OWN)).unionByName(carried(t, history, lead))
    blocks = both.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("kind", "turn", "role", "text"))).alias("turns"))
    later = F.col("turns")[0]["kind"] == BORDER
    blocks = blocks.select("conv_id", "block", later.alias("later"), F.filter("turns", lambda x: x["kind"] != BORDER).alias("turns"))

    def written(x: Column, i: Column) -> Column:
        head, body = F.concat(F.lit("### "), escaped(x["role"], ROLE_MARKS), F.lit(":\n")), escaped(x["text"], TEXT_MARKS)
        leads = (x["kind"] == LEADING) | (~F.col("later") & (i == 0) & (x["role"] == "system") & (tokens(x["text"]) <= lead))
        return F.struct(
            x["kind"].alias("kind"), leads.alias("lead"), (x["role"] == "assistant").alias("learn"), tokens(x["text"]).alias("tokens"),
            F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit("</turn>\n")).alias("line"),
        )

    blocks = blocks.select("conv_id", "block", F.transform("turns", written).alias("lines"))
    # prefix sums: the tokens before each turn, the system turn apart
    sums = F.aggregate("lines", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(x["lead"], 0).otherwise(x["tokens"]))))
    led = F.coalesce(F.get(F.filter("lines", lambda x: x["lead"]), F.lit(0))["tokens"], F.lit(0))
    blocks = blocks.select("conv_id", "block", "lines", sums.alias("sums"), led.alias("led"))
    number = lambda x, before: F.struct(x["kind"].alias("kind"), x["lead"].alias("lead"), x["tokens"].alias("tokens"), before.alias("before"))
    blocks = blocks.select("conv_id", "block", "lines", "led", F.zip_with("lines", F.slice("sums", 1, F.size("lines")), number).alias("numbers"))

    def with_base(x: Column) -> Column:
        """What a window that starts here holds before it, and where its history starts."""
        reach = F.array_min(F.transform(F.filter("numbers", lambda y: ~y["lead"] & (y["before"] < x["before"]) & (x["before"] - y["before"] <= history)), lambda y: y["before"]))
        reach = F.coalesce(reach, x["before"])
        fits = F.col("led") + x["before"] - reach + x["tokens"] <= budget
        since = F.when(x["lead"] | ~fits, x["before"]).otherwise(reach)
        base = F.when(x["lead"], 0).otherwise(F.col("led") + x["before"] - since)
        return F.struct(x["kind"].alias("kind"), x["tokens"].alias("tokens"), base.alias("base"), since.alias("since"), x["before"].alias("before"))

    blocks = blocks.select("conv_id", "block", "lines", F.transform("numbers", with_base).alias("numbers"))
    empty = F.struct(F.lit(-1).alias("window"), F.lit(0).cast("long").alias("fill"), F.expr("cast(array() as array<struct<window:int,fill:bigint>>)").alias("out"))

    def taken(acc: Column, x: Column) -> Column:
        """The next turn goes into the window if all of it fits, else into a new one."""
        fits = (acc["window"] >= 0) & (acc["fill"] + x["tokens"] <= budget)
        own = x["kind"] == OWN
        window = F.when(~own | fits, acc["window"]).otherwise(acc["window"] + 1)
        fill = F.when(~own, acc["fill"]).when(fits, acc["fill"] + x["tokens"]).otherwise(x["base"] + x["tokens"])
        return F.struct(window.alias("window"), fill.alias("fill"), F.concat(acc["out"], F.array(F.struct(F.when(own, window).otherwise(-1).alias("window"), fill.alias("fill")))).alias("out"))

    blocks = blocks.withColumn("windows", F.aggregate("numbers", empty, taken, lambda a: a["out"]))
    placed = lambda x, i: x.withField("window", F.get("windows", i)["window"]).withField("before", F.get("numbers", i)["before"])
    opening = lambda x, i: F.struct(F.get("windows", i)["window"].alias("window"), x["since"].alias("since"), x["before"].alias("before"))
    starts = F.filter(F.transform("numbers", opening), lambda x, i: (x["window"] >= 0) & ((i == 0) | (x["window"] != F.get("windows", i - 1)["window"])))
    blocks = blocks.select("conv_id", "block", F.transform("lines", placed).alias("lines"), starts.alias("starts"), "windows")

    def cut(s: Column) -> Column:
        """One window's lines: only these leave the block's row, not the whole block once for each window."""
        again = F.filter("lines", lambda x: F.when(x["lead"], x["window"] != s["window"]).otherwise((x["before"] >= s["since"]) & (x["before"] < s["before"])))
        return F.struct(
            s["window"].alias("window"), F.filter("lines", lambda x: x["window"] == s["window"]).alias("mine"), again.alias("again"),
            F.array_max(F.transform(F.filter("windows", lambda x: x["window"] == s["window"]), lambda x: x["fill"])).alias("tokens"),
        )

    w = blocks.select("conv_id", "block", F.explode(F.transform("starts", cut)).alias("w")).select("conv_id", "block", "w.*")
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def masked(acc: Column, x: Column) -> Column:
        span_ = F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length")))
        return F.struct((acc["at"] + F.length(x["line"])).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span_)).otherwise(acc["spans"]).alias("spans"))

    text = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "")
    w = w.select(
        "conv_id", "block", "window", F.size("again").alias("n_repeated"), F.size("mine").alias("n_own"), "tokens",
        text("again").alias("repeated"), text("mine").alias("own"), F.aggregate("mine", none, masked, lambda a: a["spans"]).alias("spans"),
    )
    loss = F.transform("spans", lambda s: F.struct((s["start"] + F.length("repeated")).alias("start"), s["length"].alias("length")))
    return w.select("conv_id", "block", "window", F.concat("repeated", "own").alias("formatted"), "tokens", "n_own", "n_repeated", loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: the turns as they were, and what is under the loss mask."""
    lines = F.split("formatted", "</turn>\n")
    own = F.slice(lines, F.col("n_repeated") + 1, F.size(lines) - F.col("n_repeated") - 1)

    def turn(x: Column) -> Column:
        at = F.locate(":\n", x)
        role = F.substring(x, F.lit(5), at - 5)
        text = F.substring(x, at + 2, F.length(x))
        return F.concat(unescaped(role, ROLE_MARKS), F.lit("\n"), unescaped(text, TEXT_MARKS), F.lit("\n"))

    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), TEXT_MARKS))
    w = windows.select(
        "conv_id", "block", "window", F.size(own).alias("n"), F.array_join(F.transform(own, turn), "").alias("turns"),
        F.array_join(learned, "").alias("learned"), F.length("formatted").alias("chars"),
    )
    c = w.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("block", "window", "turns", "learned"))).alias("all"))
    whole = lambda f: F.array_join(F.transform("all", lambda x: x[f]), "")
    c = c.select("conv_id", "n_turns", "formatted_chars", whole("turns").alias("turns"), whole("learned").alias("learned"))
    return c.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sample = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    return read_back(formatted(rows.unionByName(sample)))


ORACLE = rf"""
with recursive t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as id, cast(floor(coalesce(turn, -1152921504606846976) / {BLOCK}.0) as bigint) as blk,
    length(text) // {LETTERS} + {OVERHEAD} as tokens,
    4 + length(role) + len(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + 2 + length(text) + len(regexp_replace(text, '[^\\#<]', '', 'g')) + 8 as chars from t
), f as (
  select *, min(blk) over (partition by conv_id) as first_blk, first_value(turn) over c as first_turn, first_value(role) over c = 'system' as led,
    id = 1 and role = 'system' and tokens <= {LEAD} as is_lead from p window c as (partition by conv_id order by id)
), l as (select conv_id, tokens as lead_tokens, chars as lead_chars from f where is_lead),
b as (select conv_id, blk, lead(blk) over (partition by conv_id order by blk) as next from (select distinct conv_id, blk from f)),
tail as (
  select *, sum(tokens) over (partition by conv_id, blk order by turn desc range between unbounded preceding and current row) as upto from f
  where turn is not null and not (led and blk = first_blk and turn is not distinct from first_turn and role = 'system')
), e as (
  select conv_id, blk, id, tokens, chars, true as own, is_lead from f
  union all select tail.conv_id, b.next, id, tokens, chars, false, false from tail join b on tail.conv_id is not distinct from b.conv_id and tail.blk = b.blk where upto <= {HISTORY} and b.next is not null
), s as (
  select *, coalesce(sum(case when is_lead then 0 else tokens end) over (partition by conv_id, blk order by id rows between unbounded preceding and 1 preceding), 0) as before from e
), r as (
  select *, coalesce(min(before) filter (not is_lead) over (partition by conv_id, blk order by before range between {HISTORY} preceding and current row), before) as reach from s
), o as (
  select r.*, coalesce(lead_tokens, 0) as lead_tokens, lead_chars, case when is_lead or coalesce(lead_tokens, 0) + before - reach + tokens > {BUDGET} then before else reach end as since,
    row_number() over (partition by r.conv_id, blk order by id) - 1 as n from r left join l on r.conv_id is not distinct from l.conv_id where own
), o2 as (select *, case when is_lead then 0 else lead_tokens + before - since end as base from o),
g as (
  select conv_id, blk, n, 0 as win, base + tokens as fill, true as opens from o2 where n = 0
  union all select o2.conv_id, o2.blk, o2.n, case when g.fill + o2.tokens <= {BUDGET} then win else win + 1 end, case when g.fill + o2.tokens <= {BUDGET} then g.fill + o2.tokens else base + o2.tokens end,
    g.fill + o2.tokens > {BUDGET}
  from g join o2 on g.conv_id is not distinct from o2.conv_id and g.blk = o2.blk and o2.n = g.n + 1
), w as (select o2.* from g join o2 on g.conv_id is not distinct from o2.conv_id and g.blk = o2.blk and g.n = o2.n where opens),
again as (
  select w.conv_id, sum(s.chars) as chars from w join s on w.conv_id is not distinct from s.conv_id and w.blk = s.blk and not s.is_lead and s.before >= w.since and s.before < w.before group by w.conv_id
), leads as (select conv_id, sum(case when is_lead then 0 else lead_chars end) as chars from w where lead_chars is not null group by conv_id),
d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by id)) as turns_sha256,
    coalesce(string_agg(text, '' order by id) filter (role = 'assistant'), '') as learned, sum(chars) as chars from p group by conv_id
)
select d.conv_id, d.n_turns, d.turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256,
  cast(d.chars + coalesce(again.chars, 0) + coalesce(leads.chars, 0) as bigint) as formatted_chars
from d left join again on d.conv_id is not distinct from again.conv_id left join leads on d.conv_id is not distinct from leads.conv_id
"""
