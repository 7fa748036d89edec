"""Messages spelled in characters that show as nothing: rows (doc_id, kind, run, message), run counted from 0 within a kind.

The tag characters U+E0000 to U+E007F stand for ASCII. They come as such (`tag`) or as numeric character references (`entity`).
A run counts if its printable characters, without outer white space, are six or more in two words or more. Null and empty texts
have none; repeated rows give theirs as they come; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import trimmed

FIRST, LAST = 0xE0000, 0xE007F
_SHOWN = [9, 10, 13, *range(32, 127)]
_ALL = _SHOWN + sorted(set(range(128)) - set(_SHOWN))  # what has no counterpart in the second string goes
TAGS, ASCII = "".join(chr(FIRST + i) for i in _ALL), "".join(map(chr, _SHOWN))
TAG_RUN = r"[\x{E0000}-\x{E007F}]+"
#: References to FIRST..LAST, in base 16 or 10.
ENTITY_RUN = r"(?:&#(?:[xX]0*[eE]00[0-7][0-9a-fA-F]|0*9175(?:0[4-9]|[1-9][0-9])|0*9176(?:[0-2][0-9]|3[01]));)+"
LEAST_WORDS, LEAST_CHARACTERS = 2, 6


def _referred(run: Column) -> Column:
    """The ASCII characters that a run of references stands for."""

    def shown(ref: Column) -> Column:
        number = F.when(ref.rlike("^[xX]"), F.conv(F.substring(ref, 2, 20), 16, 10)).otherwise(ref).cast("int") - FIRST
        return F.when((number >= 32) & (number < 127) | number.isin(9, 10, 13), F.char(number)).otherwise("")

    return F.array_join(F.transform(F.regexp_extract_all(run, F.lit("&#([xX]?[0-9a-fA-F]+);"), F.lit(1)), shown), "")


def hidden_messages(docs: DataFrame) -> DataFrame:
    """All readable runs of both kinds."""
    every = lambda p: F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
    tags = F.transform(every(TAG_RUN), lambda r: F.translate(r, TAGS, ASCII))
    kinds = {"tag": tags, "entity": F.transform(every(ENTITY_RUN), _referred)}
    runs = [_numbered(kind, found) for kind, found in kinds.items()]
    rows = docs.select("doc_id", F.inline(F.concat(*runs)))
    words = F.size(F.filter(F.split("message", r"[ \t\r\n]+"), lambda w: w != ""))
    return rows.where((words >= LEAST_WORDS) & (F.length("message") >= LEAST_CHARACTERS))


def _numbered(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("run"), trimmed(m).alias("message")))
