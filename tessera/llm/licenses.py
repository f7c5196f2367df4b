"""Licence scans by matching marked-up templates.

A template is licence wording with optional regions, <<beginOptional>>...<<endOptional>>, and replaceable ones, <<var;match="...">>. It is
compiled into an automaton over words: mandatory words must stand as they are, optional regions may be left out, and a replaceable region
takes one word or more, each of which matches its pattern. A text has the template's label where the automaton accepts a run of its words; all places are tried in one pass over the words. Beside
these labels, the base phrases are counted at every place where their words stand consecutively.

Cases: null and empty texts have no words, no labels (an empty string) and score 0; ties between templates give all their labels; other
columns are ignored; a template without a mandatory word would match nothing in particular and is an error; a word that holds a base phrase's word only in part doesn't match."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, documents, lean, texts, words
from tessera.llm.decontaminate import split
from tessera.llm.license_texts import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

class Automaton:
    """States 0 to n; moves[s]: word -> states; wild[s]: (pattern, state); skips: states reached without a word."""

    def __init__(self, template: str) -> None:
        self.moves: list[dict[bytes, set[int]]] = [{}]
        self.wild: list[list[tuple[re.Pattern, int]]] = [[]]
        self.skip: list[set[int]] = [set()]
        self.needed: list[bytes] = []
        stack, at, mandatory = [], 0, 0
        for piece in re.findall(r"<<[^>]*>>|(?:(?!<<).)+", template, re.S):
            if piece == "<<beginOptional>>":
                stack.append(at)
            elif piece == "<<endOptional>>":
                self.skip[stack.pop()].add(at)
            elif piece.startswith("<<var"):
                pattern = re.compile(re.search(r'match="([^"]*)"', piece)[1].encode())
                new = self._state()
                self.wild[at].append((pattern, new))
                self.wild[new].append((pattern, new))
                at = new
                mandatory += not stack
            else:
                for w in split(piece):
                    new = self._state()
                    self.moves[at].setdefault(w, set()).add(new)
                    if not stack:
                        self.needed.append(w)
                        mandatory += 1
                    at = new
        if not self.needed:
            raise ValueError("a template needs a mandatory word")
        self.end, self.words = at, mandatory
        self.first = {w for s in self._closure({0}) for w in self.moves[s]}
        self.open = any(self.wild[s] for s in self._closure({0}))

    def _state(self) -> int:
        self.moves.append({})
        self.wild.append([])
        self.skip.append(set())
        return len(self.moves) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, done = list(states), set(states)
        while todo:
            new = self.skip[todo.pop()] - done
            done |= new
            todo += new
        return done

    def find(self, w: list[bytes]) -> tuple[int, int] | None:
        """The run of words that is accepted first: where it begins, at the earliest, and ends."""
        begin, live = self._closure({0}), {}  # state -> where its run began
        known: dict[tuple[re.Pattern, bytes], bool] = {}
        for k, x in enumerate(w):
            if x in self.first or self.open:
                for s in begin:
                    live.setdefault(s, k)
            new: dict[int, int] = {}
            for s, at in live.items():
                for t in self.moves[s].get(x, ()):
                    new[t] = min(at, new.get(t, at))
                for p, t in self.wild[s]:
                    if (p, x) not in known:
                        known[p, x] = bool(p.fullmatch(x))
                    if known[p, x]:
                        new[t] = min(at, new.get(t, at))
            live = {}
            for s in sorted(new, key=new.get):
                for t in self._closure({s}):
                    live.setdefault(t, new[s])
            if self.end in live:
                return live[self.end], k + 1
        return None


def _hashes(w: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(w), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM)[2]


FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licences of docs (doc_id, text). score: the largest share of a template's mandatory words among the words its run took, 0.5 where only a base phrase stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(p.encode().split(), label) for p, label in phrases.items()]
        hashed = [_hashes(p) for p, _ in base]
        machines = [(label, Automaton(t)) for label, t in templates]
        anchors = np.array([_hashes([max(m.needed, key=len)])[0] for _, m in machines], np.uint64)
        for part, data, offsets in texts(batches):
            starts, ends, h, first = words(data, offsets, ALNUM)
            rows = len(offsets) - 1
            n_base, low, high = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            labels: list[set[str]] = [set() for _ in range(rows)]
            scores = np.zeros(rows)
            for (phrase, label), g in zip(base, hashed, strict=True):
                at = np.flatnonzero(h == g[0])
                at = at[at + len(g) <= len(h)]
                for j in range(1, len(g)):
                    at = at[h[at + j] == g[j]]
                doc = np.searchsorted(first, at, "right") - 1
                at, doc = at[ok := at + len(g) <= first[doc + 1]], doc[ok]
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, at - first[doc])
                np.maximum.at(high, doc, at - first[doc])
                scores[doc] = 0.5
                for d in np.unique(doc):
                    labels[d].add(label)
            found = [set(x) for x in labels]
            for d in range(rows) if not len(anchors) else np.unique(np.searchsorted(first, np.flatnonzero(np.logical_or.reduce([h == a for a in anchors])), "right") - 1):
                w = split(data[offsets[d] : offsets[d + 1]].tobytes().decode())
                there = set(w)
                for label, m in machines:
                    if there.issuperset(m.needed) and (run_ := m.find(w)):
                        found[d].add(label)
                        scores[d] = max(scores[d], 0.5, m.words / (run_[1] - run_[0]) if run_[1] - run_[0] > m.words else 1.0)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array([",".join(sorted(x)) for x in found], pa.string()), pa.array(scores)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(run), FIELDS)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
