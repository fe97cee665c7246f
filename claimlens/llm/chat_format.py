"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns form a tree. Sorted by the chained
hashes of their turns they lie in depth-first order, so one pass over a sorted
range emits every turn once, after its ancestors: a conversation only adds the
turns behind the ones it shares with its predecessor. Output goes to packs of
about ``PACK_CHARS`` code points; a new pack, or a new range, repeats the
ancestors of its first conversation. Ranges and packs are cut between any two
conversations, so a first turn, or a whole conversation, that a third of all
rows share never meets in one task.

A pack holds the formatted text of its turns and, for each turn, its place, its
parent, its first position id (the length of its ancestors), its loss span and
the intervals it attends to (its ancestors', then its own up to each token).

Template: ``[SYS]..[/SYS]``, ``[INST]..[/INST]``, ``<s>..</s>`` for system,
user and assistant, ``[ROLE:name]..[/ROLE]`` for others. In texts a backslash
precedes every backslash, ``[``, ``<`` and ``]``, so no control string can occur
in a text, and reading back removes them.

Defined results: null role and null text are empty; turns are read by turn,
then role, then text (a null turn first; repeated rows are turns of their
own); a null conv_id is one conversation; an empty table gives no packs. Extra
columns are ignored. One conversation is held in memory, no group is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_CHARS, PACK_CONVERSATIONS = 1 << 16, 2048

# The control strings of the template.
TAGS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
LEARNED_ROLE = "assistant"
_SPECIAL, _ESCAPED = re.compile(r"[\\\[\]<]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"(?:\[SYS\]|\[INST\]|<s>|\[ROLE:((?:[^\\\]]|\\.)*)\])((?:[^\\\[<]|\\.)*)(\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])", re.S)
_ROLE_OF = {close: role for role, (_, close) in TAGS.items()}


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn and the span of its text in it."""
    opening, closing = TAGS.get(role) or (f"[ROLE:{escape(role)}]", "[/ROLE]")
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_ROLE_OF.get(m[3]) if m[3] != "[/ROLE]" else unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turn rows -> conversations with the chained hashes of their turns."""
    def rows():
        for batch in it:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out, size, now, turns = [], 0, None, []

    def close():
        chain, path = hashlib.blake2b(digest_size=8), []
        for role, text in turns:
            chain.update(f"{len(role)},{len(text)};{role}{text}".encode())
            path.append(int.from_bytes(chain.copy().digest(), "little", signed=True))
        out.append((now, path, [r for r, _ in turns], [t for _, t in turns]))

    def batch_of():
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
        cols = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays(cols, ["conv_id", "path", "roles", "texts"])

    for conv, _, role, text in rows():
        if turns and conv != now:
            close()
            turns = []
            if size > 4 << 20:
                yield batch_of()
                out, size = [], 0
        now = conv
        turns.append((role, text))
        size += len(text) + 100
    if turns:
        close()
    if out:
        yield batch_of()


PACKS = ("formatted string, start array<int>, length array<int>, parent array<int>, position array<int>, "
         "loss array<struct<start:int,end:int>>, attends array<array<struct<start:int,end:int>>>, "
         "conversations array<struct<conv_id:bigint,node:int>>")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PACK_TYPES = [pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(_SPAN), pa.list_(pa.list_(_SPAN)),
               pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))]
_PACK_NAMES = ["formatted", "start", "length", "parent", "position", "loss", "attends", "conversations"]


class _Pack:
    def __init__(self):
        self.text, self.size, self.conversations = [], 0, []
        self.start, self.length, self.parent, self.position, self.loss, self.attends = [], [], [], [], [], []
        self.path: list[tuple[str, str, int]] = []  # (role, text, node) of the last conversation

    def add(self, conv, roles: list[str], texts: list[str]) -> None:
        same = 0
        while same < min(len(self.path), len(roles)) and self.path[same][:2] == (roles[same], texts[same]):
            same += 1
        del self.path[same:]
        for role, text in zip(roles[same:], texts[same:]):
            up = self.path[-1][2] if self.path else -1
            formatted, a, z = render(role, text)
            node = len(self.start)
            self.start.append(self.size)
            self.length.append(len(formatted))
            self.parent.append(up)
            self.position.append(self.position[up] + self.length[up] if up >= 0 else 0)
            self.loss.append({"start": self.size + a, "end": self.size + z} if role == LEARNED_ROLE else None)
            seen = [dict(s) for s in self.attends[up]] if up >= 0 else []
            if seen and seen[-1]["end"] == self.size:
                seen[-1]["end"] += len(formatted)
            else:
                seen.append({"start": self.size, "end": self.size + len(formatted)})
            self.attends.append(seen)
            self.text.append(formatted)
            self.size += len(formatted)
            self.path.append((role, text, node))
        self.conversations.append({"conv_id": conv, "node": self.path[-1][2]})

    def row(self) -> list:
        return ["".join(self.text), self.start, self.length, self.parent, self.position, self.loss, self.attends, self.conversations]


def _pack(chars: int, conversations: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(pack.row(), _PACK_TYPES)], _PACK_NAMES)

        for b in it:
            for conv, roles, texts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if pack.conversations and (pack.size >= chars or len(pack.conversations) >= conversations):
                    yield batch()
                    pack = _Pack()
                pack.add(conv, roles, texts)
        if pack.conversations:
            yield batch()

    return run


def format_conversations(turns: DataFrame, pack_chars: int = PACK_CHARS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) -> packs."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conversations = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .mapInArrow(_gather, "conv_id bigint, path array<bigint>, roles array<string>, texts array<string>")
    return conversations.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_pack(pack_chars, pack_conversations), PACKS)


def read_back(packs: DataFrame) -> DataFrame:
    """Conversations read from the packs: conv_id, roles, texts, learned (text under the loss mask), formatted."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for p in batch.to_pylist():
                out = []
                for c in p["conversations"]:
                    nodes, at = [], c["node"]
                    while at >= 0:
                        nodes.append(at)
                        at = p["parent"][at]
                    nodes.reverse()
                    formatted = "".join(p["formatted"][s["start"]:s["end"]] for s in p["attends"][c["node"]])
                    turns = parse(formatted)
                    masks = [p["loss"][n] for n in nodes if p["loss"][n] is not None]
                    learned = "".join(unescape(p["formatted"][m["start"]:m["end"]]) for m in masks)
                    out.append((c["conv_id"], [r for r, _ in turns], [t for _, t in turns], learned, formatted))
                    if len(out) >= 200:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    def rows(out):
        types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)],
                                          ["conv_id", "roles", "texts", "learned", "formatted"])

    return packs.mapInArrow(run, "conv_id bigint, roles array<string>, texts array<string>, learned string, formatted string")


PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    got = read_back(format_conversations(turns.unionByName(probe)))
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    return got.select("conv_id", F.size("roles").cast("bigint").alias("n_turns"), F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
                      F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l as (
  select *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) + case role when 'system' then 11 when 'user' then 13
    when 'assistant' then 7 else 14 + length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) end as n from t)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from l group by conv_id
"""
