"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at a place; the
dynamic programme keeps, for each place, the best score and the number of pieces
on the way there, never the pieces. Rules as in the public unigram tokenizers:

* a space is U+2581, and one stands before the text;
* of equal scores, the first by start (the longest last piece) wins;
* a character that is no piece itself may stand as unknown, at the least score
  of the vocabulary less 10; it counts as its UTF-8 bytes where the vocabulary has
  all byte pieces, and runs of unknown characters count as one piece where not.

No piece of the usual vocabularies crosses from a word into a following space, or
holds a line feed, so that the best path of a text is made of the best paths of its
words; counts of words are kept. A vocabulary that does have such pieces is run
over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ready

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Word counts that a worker keeps before it starts afresh, and the longest words (in characters) that it keeps: some 50 MB for each of its two tables at most.
CACHED, LONGEST = 250_000, 32


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.by_words = self.by_bytes and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Pieces on the best path of a text, spaces already U+2581."""
        n = len(text)
        if not n:
            return 0
        best = [float("-inf")] * (n + 1)
        count, unknown_end = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):  # no unknown character can be needed
            for last, (size, score) in self.automaton.iter(text):
                end = last + 1
                start = end - size
                total = best[start] + score
                if total > best[end]:
                    best[end], count[end] = total, count[start] + 1
            return count[n]
        done = 0  # places up to here are final

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                # the unknown character comes last for its end: it starts last
                char = text[done]
                if char not in self.single and (score := best[done] + self.unknown) > best[done + 1]:
                    best[done + 1], unknown_end[done + 1] = score, True
                    count[done + 1] = count[done] + (len(char.encode()) if self.by_bytes else 0 if unknown_end[done] else 1)
                done += 1

        if len(self.automaton):
            for last, (size, score) in self.automaton.iter(text):
                settle(last)
                start = last + 1 - size
                if (total := best[start] + score) > best[last + 1]:
                    best[last + 1], count[last + 1], unknown_end[last + 1] = total, count[start] + 1, False
        settle(n)
        return count[n]

    def _word(self, word: str, table: dict[str, int], before: str) -> int:
        n = self.run(before + word)
        if len(word) <= LONGEST:
            if len(table) >= CACHED:
                table.clear()
            table[word] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for a null or empty one."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not self.by_words:
            return self.run(SPACE + text.replace(" ", SPACE))
        lines = text.split("\n")
        total = len(lines) - 1  # a line feed is one byte
        spaced, bare = self.spaced, self.bare
        for k, line in enumerate(lines):
            first, *rest = line.split(" ")
            if "" in rest or (not k and not first and rest):
                for segment in re.findall(r" +[^ ]*|[^ ]+", line if k else f" {line}"):
                    total += self._word(segment.replace(" ", SPACE), bare, "") if (n := bare.get(segment.replace(" ", SPACE))) is None else n
                continue
            if k:
                if first:
                    total += self._word(first, bare, "") if (n := bare.get(first)) is None else n
            elif first or rest or len(lines) > 1:
                total += self._word(first, spaced, SPACE) if (n := spaced.get(first)) is None else n
            for word in rest:
                total += self._word(word, spaced, SPACE) if (n := spaced.get(word)) is None else n
        return total


_counters: dict[int, Counter] = {}


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: list[tuple[str, float]]) -> Iterator[pa.RecordBatch]:
    key = hash(tuple(vocabulary))
    counter = _counters.setdefault(key, None) or Counter(vocabulary)
    _counters[key] = counter
    for batch in batches:
        counts = [counter.count(t) for i in range(0, batch.num_rows, 64) for t in batch.column(batch.num_columns - 1)[i : i + 64].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens; 0 for a null or empty text. Other columns are ignored.

    The vocabulary (bounded: a tokenizer's file) is broadcast.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _counted(it, shared.value), f"{fields + ', ' if fields else ''}n_tokens long")
