"""Chat formatting with Spark expressions only: conversations as one text each, with the spans that a loss counts.

The rows of a conversation are collected as structs and sorted; turns of one role that follow each other are merged under
one header; the pieces are joined.  The text of a conversation is

    ### ROLE:⏎TEXT</turn>⏎### ROLE:⏎TEXT</part>TEXT</turn>⏎

where ``</part>`` stands between the texts of a merged turn, so that every row can be read back.  In texts and roles a
backslash is doubled and one is put into each control string (``#\\##``, ``<\\/turn>``, ``<\\/part>``, in roles also before
a line end that follows a colon), so that no control string but the template's own is in the output; ``unescaped`` undoes that.
``loss`` holds the spans (start from 0, size, in bytes of UTF-8) of the texts of the roles that are learned, without
headers and ends.

Rows are ordered by turn, then role, then text; null turns come first; null texts and roles are empty; repeated rows are
turns each; rows of null conversations are one conversation; an empty table gives an empty one; other columns are
ignored.  A conversation is one row of the result, and its rows meet in one task; sorting aside, work grows with its
bytes, and with the power 1.5 of its turns for the running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, NAMED, PART, END = "### ", ":\n", "</part>", "</turn>\n"
LEARNED = ("assistant",)


def escaped(text: Column, role: bool = False) -> Column:
    """``text`` with a backslash in each control string and all its own doubled."""
    marks = r"#(?=##)|<(?=/(?:turn|part)>)" + (r"|:(?=\n)" if role else "")
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/\n])", "$1")


def glued(parts: Column) -> Column:
    return F.array_join(parts, "")


def formatted(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conversation, n_turns, formatted, loss) of each conversation."""
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = rows.groupBy(conversation).agg(F.array_sort(F.collect_list(own)).alias("__turns"))
    # the roles before and after each turn's; arrays are zipped, as one looked up inside a lambda may be made anew for each element
    roles, none = F.transform("__turns", lambda x: x["role"]), F.array(F.lit(None).cast("string"))
    shifted = F.concat(none, F.slice("__roles", F.lit(1), F.size("__roles") - 1)), F.concat(F.slice("__roles", F.lit(2), F.size("__roles")), none)
    beside = turns.withColumn("__roles", roles).select(conversation, F.arrays_zip("__turns", shifted[0].alias("last"), shifted[1].alias("next")).alias("__turns"))

    def piece(x: Column) -> Column:
        """A turn as (before, text, after, learned): the header only where the role changes, the end only before it changes again."""
        own, last, next_ = x["__turns"], x["last"], x["next"]
        head = F.concat(F.lit(HEAD), escaped(own["role"], role=True), F.lit(NAMED))
        before, after = F.when(last.eqNullSafe(own["role"]), PART).otherwise(head), F.when(next_.eqNullSafe(own["role"]), "").otherwise(END)
        return F.struct(before.alias("before"), escaped(own["text"]).alias("text"), after.alias("after"), own["role"].isin(*learned).alias("learned"))

    out = beside.select(conversation, F.transform("__turns", piece).alias("__pieces"))
    sizes = F.transform("__pieces", lambda x: (F.octet_length(x["before"]) + F.octet_length(x["text"]) + F.octet_length(x["after"])).cast("long"))
    out = with_running(out.withColumn("__sizes", sizes), "__sizes", "__starts")
    span = lambda x: F.struct((x["__starts"] + F.octet_length(x["__pieces"]["before"])).alias("start"), F.octet_length(x["__pieces"]["text"]).cast("long").alias("size"))
    loss = F.transform(F.filter(F.arrays_zip("__pieces", "__starts"), lambda x: x["__pieces"]["learned"]), span)
    joined = glued(F.transform("__pieces", lambda x: F.concat(x["before"], x["text"], x["after"])))
    return out.select(conversation, F.size("__pieces").cast("long").alias("n_turns"), joined.alias("formatted"), loss.alias("loss"))


def with_running(df: DataFrame, sizes: str, to: str) -> DataFrame:
    """``df`` with the array ``to``: for each number in the array ``sizes`` the sum of those before it.

    A fold copies the array it builds at each step, so there is one fold for each of sqrt(n) blocks, and one over the blocks' sums.
    """
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sizes)), F.col("__side"))
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = lambda block, first: F.aggregate(block, F.array(first).cast("array<long>"), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    df = df.withColumn("__side", side).withColumn("__blocks", F.transform(starts, lambda s: F.slice(sizes, s, F.col("__side"))))
    before = F.slice(sums(F.transform("__blocks", total), F.lit(0).cast("long")), F.lit(1), F.size("__blocks"))
    every = F.flatten(F.zip_with("__blocks", before, lambda block, first: F.slice(sums(block, first), F.lit(1), F.size(block))))
    return df.withColumn(to, every).drop("__side", "__blocks")


def read(chats: DataFrame) -> DataFrame:
    """``chats`` (``formatted``) with what their texts and spans say: turns (role, text) and learned, the texts under the mask."""
    blocks = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    role = lambda x: unescaped(F.substring_index(F.substring(x, F.lit(len(HEAD) + 1), F.length(x)), NAMED, 1))
    body = lambda x: F.substring(x, F.instr(x, NAMED) + len(NAMED), F.length(x))
    turn = lambda x: F.transform(F.split(body(x), PART, -1), lambda t: F.struct(role(x).alias("role"), unescaped(t).alias("text")))
    under = lambda data: F.transform("loss", lambda s: unescaped(F.substring(data, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string")))
    # the bytes are an array's only element, so that they are made once and not for each span
    learned = F.get(F.transform(F.array(F.col("formatted").cast("binary")), under), F.lit(0))
    return chats.withColumn("turns", F.flatten(F.transform(blocks, turn))).withColumn("learned", learned)
