"""Chat formatting of event logs.

A log row is an event of a message: ``message`` or ``edit`` sets its text, ``delta`` appends to it, and
``regenerate`` voids what came before of this message and of all later ones. Logs are partitioned by
conversation and sorted by sequence; a backward running minimum over regenerations tells which events are
void, and what is left of a message folds into its final text. Messages are then rendered one by one, and
reading back goes through a conversation message by message, so no task ever holds a conversation.
"""
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What marks turns. None of these is left bare in a rendered text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[SAYS]", "[/ROLE]")
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<s>[SYS] ", " [/SYS]")}
OTHER = ("<s>[ROLE] ", " [SAYS] ", " [/ROLE]")
LEARNED = "assistant"

_ANY = "|".join(re.escape(c) for c in CONTROL)
_MARKED = re.compile(rf"(\\*)({_ANY})")


def escaped(text: Column) -> Column:
    """Doubles the backslashes before a control string and adds one."""
    return F.regexp_replace(text, rf"(\\*)({_ANY})", r"$1$1\\$2")


def unescaped(text: str) -> str:
    return _MARKED.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of what is left of a log (conv_id, seq, message, kind, role, text).

    ``message`` and ``seq`` are numbers that order the messages of a conversation and its events; events
    with equal seq are taken by message, kind and text. The role is that of the first event that names
    one. A null text is empty, a null kind means ``message``, other kinds are ignored. A message of which
    a regeneration left nothing is gone. A null conv_id is one more conversation.
    """
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    kind = F.coalesce("kind", F.lit("message"))
    floor = F.min(F.when(kind == "regenerate", F.col("message"))).over(later)
    live = (events.select("conv_id", "seq", "message", kind.alias("kind"), "role",
                          F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("floor", floor).where("floor IS NULL OR message < floor")
            .where(F.col("kind").isin("message", "edit", "delta")))
    own = F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role")))
    return (live.groupBy("conv_id", "message").agg(own.alias("events"))
            .select("conv_id", "message",
                    F.get(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull()), 0)
                    .alias("role"),
                    F.aggregate("events", F.lit(""), lambda text, e: F.when(
                        e["kind"] == "delta", F.concat(text, e["text"])).otherwise(e["text"])).alias("text")))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, message, formatted, loss_from, loss_to): the text of each message under the template.

    A conversation is its messages' ``formatted`` one after the other, in order. Code points loss_from to
    loss_to - 1 of a message are learned: an assistant's escaped text, nothing else. A null role has an
    empty name.
    """
    text = escaped(F.coalesce("text", F.lit("")))
    name = F.coalesce("role", F.lit(""))
    out = F.concat(F.lit(OTHER[0]), escaped(name), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for role, (head, tail) in FRAMES.items():
        out = F.when(name == role, F.concat(F.lit(head), text, F.lit(tail))).otherwise(out)
    begin = F.lit(len(FRAMES[LEARNED][0]))
    learned = name == LEARNED
    return messages.select("conv_id", "message", out.alias("formatted"),
                           F.when(learned, begin).otherwise(0).alias("loss_from"),
                           F.when(learned, begin + F.length(text)).otherwise(0).alias("loss_to"))


def parsed(formatted: str) -> tuple[str, str]:
    """(role, text) of one rendered message."""
    for role, (head, tail) in FRAMES.items():
        if formatted.startswith(head) and formatted.endswith(tail):
            return role, unescaped(formatted[len(head):len(formatted) - len(tail)])
    head, middle, tail = OTHER
    body = formatted[len(head):len(formatted) - len(tail)]
    at = next(m.start(2) for m in _MARKED.finditer(body) if m[2] == middle.strip() and not len(m[1]) % 2)
    return unescaped(body[:at - 1]), unescaped(body[at - 1 + len(middle):])


def read_back(rows: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of rendered conversations.

    Goes through the rows sorted by conversation and message and keeps only running digests.
    """
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or current["conv_id"] != row["conv_id"]:
                    if current is not None:
                        done.append(current)
                    current = {"conv_id": row["conv_id"], "n_turns": 0, "turns": sha256(), "loss_chars": 0,
                               "loss": sha256(), "formatted_chars": 0}
                formatted = row["formatted"]
                role, text = parsed(formatted)
                current["n_turns"] += 1
                current["turns"].update(f"{role}\n{text}\n".encode())
                learned = unescaped(formatted[row["loss_from"]:row["loss_to"]])
                current["loss_chars"] += len(learned)
                current["loss"].update(learned.encode())
                current["formatted_chars"] += len(formatted)
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        if current is not None:
            yield _digests([*done, current])

    ordered = (rows.repartition("conv_id").sortWithinPartitions("conv_id", "message")
               .select("conv_id", "formatted", "loss_from", "loss_to"))
    return ordered.mapInArrow(per_task, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                        "loss_sha256 string, formatted_chars bigint")


def _digests(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "conv_id": [c["conv_id"] for c in found], "n_turns": [c["n_turns"] for c in found],
        "turns_sha256": [c["turns"].hexdigest() for c in found], "loss_chars": [c["loss_chars"] for c in found],
        "loss_sha256": [c["loss"].hexdigest() for c in found],
        "formatted_chars": [c["formatted_chars"] for c in found]})


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table (conv_id, turn, role, text): each row is one whole message.

    Rows of a conversation are numbered by turn, then role and text; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (turns.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("bigint"))
            .select("conv_id", F.col("message").alias("seq"), "message", F.lit("message").alias("kind"), "role", "text"))
