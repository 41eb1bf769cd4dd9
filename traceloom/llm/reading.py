"""Reading level of each page's own English prose by a familiar-word formula that is graded on passages read by people.

The formula takes the share of words outside a list of those that most of the corpus's articles use, and the average length of
sentences; the mean length of words stands beside them, as frequency alone doesn't tell short everyday words from long ones.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import cut_lineage

#: The familiar words are the so many that stand in most articles of the corpus.
FAMILIAR = 800

#: A line that stands with this share of all different articles (and with three at least) is page furniture; copies of an
#: article count once.  No more than lines-a-page / ``FURNITURE`` lines can be, whatever the size of the corpus.
FURNITURE = 0.002

#: Of lines with more letters a digest is the key, so that whole lines are never shuffled.  No line has the key ``ALL``.
LONG, ALL = 24, "*"

#: An article has at least so many words, so large a share of them are English function words, and of no other language's more are.
LEAST_WORDS, ENGLISH = 100, 0.13

#: The grading is fitted on at most so many graded passages, the first by their id.
GRADED = 5000

# Function words of English.
FUNCTION_WORDS = frozenset(
    "the a an and or but of to in on at by for with from as is was it that this which what not no so be are were has had have "
    "they we you he she his her its my i than then when while if because".split()
)

# Function words of other languages in Latin letters, where English has none that is written alike.
OTHER_FUNCTION_WORDS = {
    "german": frozenset("der die das und ist nicht ein eine zu den von mit sich auf dem des im auch als an wie oder aber wenn nur noch".split()),
    "french": frozenset("le la les et des est une un dans que qui pour pas sur au plus par avec ce il elle nous vous mais ou donc".split()),
    "spanish": frozenset("el la los las y de que en un una por con para no es al lo como pero su sus del se ha este esta".split()),
    "italian": frozenset("il lo la gli le e di che in un una per con non del della sono come ma anche si ha questo questa nel".split()),
    "portuguese": frozenset("o os as e de que em um uma por com para nao do da dos das no na se mais como mas foi ao".split()),
    "dutch": frozenset("de het een en van ik te dat die niet zijn is op aan met voor er maar om hem dan zou of wat mijn".split()),
}

_ENDS = re.compile(r"[.!?][\"'”’)]*\s*$")
_SENTENCE = re.compile(r"[.!?]+[\"'”’)]*(?:\s+|$)")
_WORDS = re.compile(r"[a-z]+(?:'[a-z]+)?")
_NO_LETTERS = re.compile(r"[^a-z]+")


def prose_lines(text: str | None) -> list[str]:
    """The lines of a page that can be prose: sentences, or at least a dozen words; lines broken within a sentence are joined."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    joined: list[str] = []
    for line in text.split("\n"):
        line = line.strip()
        if joined and joined[-1] and line[:1].islower() and not _ENDS.search(joined[-1]):
            joined[-1] = (joined[-1][:-1] if joined[-1].endswith("-") else joined[-1] + " ") + line
        else:
            joined.append(line)
    out = []
    for line in joined:
        if "|" in line or "…" in line:
            continue
        n = line.count(" ") + 1
        if n >= 12 or (n >= 4 and _ENDS.search(line)):
            out.append(line)
    return out


def line_key(line: str) -> str:
    """The letters of a line, which stay the same where numbers, marks or broken characters differ."""
    letters = _NO_LETTERS.sub("", line.lower())
    return letters if len(letters) <= LONG else hashlib.blake2b(letters.encode(), digest_size=16).hexdigest()


def _counted(df: DataFrame, column: str, name: str, of) -> DataFrame:
    """``(name, n)``: in how many rows each key of ``of(value)`` stands; summed within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=[name, "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                seen.update(of(value.as_py()))
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    return df.select(column).mapInArrow(run, f"{name} string, n bigint").groupBy(name).agg(F.sum("n").alias("n"))


def body(lines: dict[str, int], shared: frozenset[str]) -> str:
    """What tells a page's article from others: its longest line, given all lines by their keys with their lengths.

    The line is taken from those that aren't shared by many pages, unless these make up less than half of the page: then the
    page is a copy, and beside its shared lines there are only comments and the like.
    """
    own = {k: n for k, n in lines.items() if k not in shared}
    among = own if 2 * sum(own.values()) >= sum(lines.values()) else lines.keys() & shared
    return max(among, key=lambda k: (lines[k], k))


def furniture(documents: DataFrame, text: str) -> frozenset[str]:
    """Keys of the lines that stand with too many different articles to be anyone's own prose, over all pages.

    Lines that stand in many pages are looked at again: those of an article that is mirrored or fetched many times stand
    with that one article only.
    """
    lengths = lambda t: {line_key(x): len(x) for x in prose_lines(t)}
    counted = _counted(documents, text, "line", lambda t: lengths(t).keys())
    pages = documents.count() / 2
    while True:
        least = max(3.0, FURNITURE * pages)
        shared = frozenset(r["line"] for r in counted.where(F.col("n") >= least).select("line").collect())
        articles_of = _different(documents, text, lengths, shared)
        pages = articles_of.pop(ALL, 0)
        # fewer articles than were reckoned with: lines that stand in fewer pages may be furniture too
        if FURNITURE * pages >= least or least == 3.0:
            return frozenset(k for k, n in articles_of.items() if n >= max(3.0, FURNITURE * pages))


def _different(documents: DataFrame, text: str, lengths, shared: frozenset[str]) -> dict[str, int]:
    """Of each of the shared lines, and of all pages under ``ALL``, the number of different articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = set()
            for value in batch.column(0):
                if lines := lengths(value.as_py()):
                    own = body(lines, shared)
                    met.update((k, own) for k in (ALL, *(lines.keys() & shared)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in met], pa.string()), pa.array([b for _, b in met], pa.string())], names=["line", "body"])

    pairs = documents.select(text).mapInArrow(run, "line string, body string").distinct()
    return {r["line"]: r["count"] for r in pairs.groupBy("line").count().collect()}


def articles(documents: DataFrame, known: frozenset[str], key: str, text: str) -> DataFrame:
    """``(key, article)``: each page's own prose, packed; pages without any come out with empty prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ["\n".join(x for x in prose_lines(v.as_py()) if line_key(x) not in known) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x.encode("utf-8", "replace"), 1) for x in own], pa.binary())], names=[key, "article"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, article binary")


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _unpack(blob: bytes) -> str:
    return zlib.decompress(blob).decode("utf-8")


def familiar_words(packed: DataFrame) -> frozenset[str]:
    """The words that stand in most articles; of equal counts the first by the alphabet."""
    counted = _counted(packed, "article", "word", lambda blob: set(_words(_unpack(blob))))
    top = counted.orderBy(F.desc("n"), "word").limit(FAMILIAR).collect()
    return frozenset(r["word"] for r in top)


@dataclass(frozen=True)
class Measures:
    """What the formula takes from a text."""

    words: int
    sentences: int
    english: float
    foreign: float
    unfamiliar: float
    letters: float

    @property
    def features(self) -> list[float]:
        return [self.unfamiliar, float(np.log(max(self.words, 1) / max(self.sentences, 1))), self.letters]


def measure(text: str, familiar: frozenset[str]) -> Measures:
    """Words, sentences, shares of English function words, of the function words of the likeliest other language and of words
    that aren't familiar, and letters in a word."""
    found = _words(text)
    n = max(len(found), 1)
    sentences = sum(1 for s in _SENTENCE.split(text) if any(c.isalpha() for c in s))
    counts = Counter(found)
    share = lambda words: sum(counts[w] for w in words) / n
    foreign = max(share(words) for words in OTHER_FUNCTION_WORDS.values())
    return Measures(len(found), sentences, share(FUNCTION_WORDS), foreign, sum(w not in familiar for w in found) / n, sum(map(len, found)) / n)


@dataclass(frozen=True)
class Grading:
    """Weights of a multinomial logistic model over the formula's measures."""

    bands: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def bands_of(self, features: np.ndarray) -> list[str]:
        z = np.c_[(features - self.mean) / self.scale, np.ones(len(features))]
        return [self.bands[i] for i in (z @ self.weights).argmax(axis=1)]


def grade(features: np.ndarray, bands: list[str], rounds: int = 3000, rate: float = 0.5, shrink: float = 1e-3) -> Grading:
    """Fit the grading to passages graded by readers, by gradient descent from zero, so that it is the same every time."""
    names = tuple(sorted(set(bands)))
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    z = np.c_[(features - mean) / scale, np.ones(len(features))]
    goal = np.eye(len(names))[[names.index(b) for b in bands]]
    weights = np.zeros((z.shape[1], len(names)))
    for _ in range(rounds):
        p = z @ weights
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= rate * (z.T @ (p - goal) / len(z) + shrink * weights)
    return Grading(names, mean, scale, weights)


def reading_levels(documents: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, words, sentence_words, unfamiliar, band, formula_band)`` of every page whose own article is English prose of
    enough words.

    ``unfamiliar`` is the share of words outside the list of familiar words.  ``formula_band`` is the band by that share and
    the sentence length alone, ``band`` by the word length too.  Lines that many different articles share, menus,
    headings, comments and fragments don't belong to the article.  Line counts and word counts go over the whole corpus;
    only bounded results come to the driver: the furniture lines, the familiar words and the graded passages.  Null and
    empty texts and other languages give no row; repeated pages come out as often as they stand in the table; without graded
    passages there are no bands and so no rows.
    """
    packed = cut_lineage(articles(documents, furniture(documents, text), key, text))
    schema = f"{key} {dict(documents.dtypes)[key]}, words bigint, sentence_words double, unfamiliar double, band string, formula_band string"
    known = graded.where("band is not null and passage is not null").orderBy("passage_id").limit(GRADED).collect()
    if not known:
        return documents.sparkSession.createDataFrame([], schema)
    familiar = familiar_words(packed)
    features, given = np.array([measure(r["passage"], familiar).features for r in known]), [r["band"] for r in known]
    model, formula = grade(features, given), grade(features[:, :2], given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took = [measure(_unpack(v.as_py()), familiar) for v in batch.column(1)]
            at = [i for i, m in enumerate(took) if m.words >= LEAST_WORDS and m.english >= ENGLISH and m.english > m.foreign]
            kept = [took[i] for i in at]
            took = np.array([m.features for m in kept]).reshape(-1, 3)
            bands, plain = (model.bands_of(took), formula.bands_of(took[:, :2])) if kept else ([], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([m.words for m in kept], pa.int64()),
                    pa.array([m.words / max(m.sentences, 1) for m in kept], pa.float64()),
                    pa.array([m.unfamiliar for m in kept], pa.float64()),
                    pa.array(bands, pa.string()),
                    pa.array(plain, pa.string()),
                ],
                names=[key, "words", "sentence_words", "unfamiliar", "band", "formula_band"],
            )

    return packed.mapInArrow(run, schema)
