"""Question records out of a model's answer while it is still coming: a scanner that goes on where the last chunk ended.

Chunks (response, seq, text) may come in any order and any cutting.  A chunk waits in map state until those before it
have come; the scanner's place is value state, and the keys of records that have been given out are map state, so each record comes
once.  What the scanner keeps of the text is the open object alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from stemforge.functions.modeljson import coerce, complete

DRAINED = "response string, ordinal long, number int, question string, options array<string>, answer string"


@dataclass
class Scanner:
    """Whole objects behind the first list bracket of a text that comes in pieces; brackets in strings do not count."""

    started: bool = False
    depth: int = 0
    quoted: bool = False
    escaped: bool = False
    held: str = ""

    def feed(self, chunk: str) -> Iterator[str]:
        """The objects that end in this chunk."""
        start = 0 if self.depth else -1
        for i, c in enumerate(chunk):
            if not self.started:
                self.started = c == "["
            elif self.depth and self.quoted:
                if self.escaped:
                    self.escaped = False
                elif c == "\\":
                    self.escaped = True
                else:
                    self.quoted = c != '"'
            elif c == "{":
                if not self.depth:
                    start = i
                self.depth += 1
            elif self.depth and c == '"':
                self.quoted = True
            elif self.depth and c == "}":
                self.depth -= 1
                if not self.depth:
                    yield self.held + chunk[start : i + 1]
                    self.held, start = "", -1
        if self.depth:
            self.held += chunk[start:]


def record_key(record: dict) -> str:
    """What makes two records of an answer the same: question, options and answer in lower case and single spaces."""
    return "\x01".join(" ".join(str(x).split()).lower() for x in [record["question"], *record["options"], record["answer"]])


def read_object(text: str) -> dict | None:
    """A complete record of an object's text; None where it cannot be read, as the whole answer is salvaged in the end."""
    try:
        record = coerce(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return record if complete(record) else None


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


class DrainProcessor(StatefulProcessor):
    """One answer's chunks to its records."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", _schema(scanner=StringType(), next_seq=LongType(), given=LongType()))
        self.waiting = handle.getMapState("waiting", _schema(seq=LongType()), _schema(text=StringType()))
        self.emitted = handle.getMapState("emitted", _schema(key=StringType()), _schema(n=IntegerType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        place, following, given = self.place.get() if self.place.exists() else ("{}", 0, 0)
        scanner = Scanner(**json.loads(place))
        for batch in rows:
            for seq, text in zip(batch["seq"], batch["text"], strict=True):
                if int(seq) >= following:
                    self.waiting.updateValue((int(seq),), (text or "",))
        out = []
        while self.waiting.containsKey((following,)):
            (text,) = self.waiting.getValue((following,))
            self.waiting.removeKey((following,))
            following += 1
            for found in scanner.feed(text):
                record = read_object(found)
                if record is None or self.emitted.containsKey((record_key(record),)):
                    continue
                self.emitted.updateValue((record_key(record),), (1,))
                given += 1
                out.append((key[0], given, record["number"], record["question"], record["options"], record["answer"]))
        self.place.update((json.dumps(asdict(scanner)), following, given))
        yield pd.DataFrame(out, columns=["response", "ordinal", "number", "question", "options", "answer"]).astype({"number": "Int32", "ordinal": "int64"})

    def close(self) -> None:
        pass


def drained(chunks: DataFrame) -> DataFrame:
    """response, ordinal, number, question, options and answer of each record as soon as its object is whole; needs the RocksDB state store.

    chunks: response, seq (from 0 without gaps) and text; a chunk that comes twice counts once.
    """
    rows = chunks.selectExpr("cast(response as string) as response", "cast(seq as long) as seq", "text")
    return rows.groupBy("response").transformWithStateInPandas(DrainProcessor(), DRAINED, "Append", "None")
