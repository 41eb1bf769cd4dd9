"""Schemas that drift between files: one consistent table of all files and a report of every change."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordered import carried, latest, with_numbers
from traceloom.session import cut_lineage

FIELDS = "array<struct<path: string, type: string, value: string>>"

#: Files of one station are compared within buckets of so many seconds of saved_at; only one file per bucket crosses.
BUCKET_S = 30 * 86_400

#: Propagation stops when no score moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-3, 60

#: Fields whose value changed are followed under a new name if flooding gives the pair this share of the best score at least,
#: neither field has a better partner, and their names share this much.
FOLLOWED, NAMED_ALIKE = 0.6, 0.4


_WRITE = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "null"


def _plain(value):
    """Numbers that are equal come out alike, however they were written."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    return [_plain(v) for v in value] if isinstance(value, list) else {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def flatten(text: str | None) -> list[tuple[str, str, str]] | None:
    """``(path, type, value)`` of every value that is no object, by path; null if ``text`` is no readable JSON object."""
    try:
        root = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    out, todo = {}, [("", root)]
    while todo:
        prefix, node = todo.pop()
        for key, value in node.items():
            if isinstance(value, dict):
                todo.append((f"{prefix}{key}.", value))
            else:
                out[f"{prefix}{key}"] = (_kind(value), _WRITE(_plain(value)))
    return [(path, *out[path]) for path in sorted(out)]


@lru_cache(maxsize=65_536)
def _grams(name: str) -> Counter:
    plain = f"  {name.lower()} "
    return Counter(plain[i : i + 3] for i in range(len(plain) - 2))


@lru_cache(maxsize=65_536)
def _like(a: str, b: str) -> float:
    """Similarity of two names by their shared triples of letters."""
    p, q = _grams(a), _grams(b)
    return 2 * sum((p & q).values()) / max(sum(p.values()) + sum(q.values()), 1)


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([[_like(x, y) for y in b] for x in a]).reshape(len(a), len(b))


def _incidence(items: list, nodes: list) -> np.ndarray:
    at = {x: i for i, x in enumerate(nodes)}
    out = np.zeros((len(items), len(nodes)))
    out[np.arange(len(items)), [at[x] for x in items]] = 1
    return out


def _share(m: np.ndarray) -> np.ndarray:
    """Every node hands its score on in equal parts to the nodes it leads to."""
    return m / np.maximum(m.sum(axis=0, keepdims=True), 1)


def flood(old: list[tuple[str, str, str]], new: list[tuple[str, str, str]]) -> np.ndarray:
    """Similarity flooding between the fields of two schema graphs: scores of every pair, the best being 1.

    Nodes are the fields, the objects that hold them, their types and their values.  A pair of fields gets score from the
    pair of objects that hold them and from the type and the value that they share, and gives score back, round by round,
    until nothing moves; similarity of names starts it.  The rounds are products of one matrix over all pairs of nodes.
    """
    values = {v: i for i, v in enumerate(dict.fromkeys(f[1:] for f in (*old, *new)))}
    return _flooded(tuple((f[0], f[1], values[f[1:]]) for f in old), tuple((f[0], f[1], values[f[1:]]) for f in new))


@lru_cache(maxsize=16_384)
def _flooded(old: tuple[tuple[str, str, int], ...], new: tuple[tuple[str, str, int], ...]) -> np.ndarray:
    """``flood`` with values as numbers, which tell the same ones: files that drift alike are flooded once in a worker."""
    parent = lambda p: p.rpartition(".")[0]
    leaf = lambda p: p.rpartition(".")[2]
    pa_, pb = sorted({parent(f[0]) for f in old}), sorted({parent(f[0]) for f in new})
    types, values = sorted({f[1] for f in (*old, *new)}), sorted({f[2] for f in (*old, *new)})
    under_a, under_b = _incidence([parent(f[0]) for f in old], pa_), _incidence([parent(f[0]) for f in new], pb)
    n, m = len(old), len(new)
    start = [_alike([leaf(f[0]) for f in old], [leaf(f[0]) for f in new]).ravel(), _alike(pa_, pb).ravel(), np.ones(len(types)), np.ones(len(values))]
    ends = np.cumsum([len(x) for x in start])
    passed = np.eye(ends[-1])
    passed[: n * m, ends[0] : ends[1]] = np.kron(_share(under_a), _share(under_b))
    passed[ends[0] : ends[1], : n * m] = np.kron(under_a.T, under_b.T) / np.maximum(np.outer(under_a.sum(0), under_b.sum(0)).ravel(), 1)[:, None]
    for at, nodes, kind in ((ends[1], types, 1), (ends[2], values, 2)):
        a, b = _incidence([f[kind] for f in old], nodes), _incidence([f[kind] for f in new], nodes)
        passed[: n * m, at : at + len(nodes)] = np.einsum("ai,bi->abi", _share(a), _share(b)).reshape(n * m, -1)
        passed[at : at + len(nodes), : n * m] = (np.einsum("ai,bi->iab", a, b) / np.maximum(a.sum(0) * b.sum(0), 1)[:, None, None]).reshape(len(nodes), -1)
    first = np.concatenate(start)
    now = first
    for _ in range(ROUNDS):
        after = passed @ (now + first)
        after /= max(after.max(), 1e-12)
        moved = np.abs(after - now).max()
        now = after
        if moved < SETTLED:
            break
    return now[: n * m].reshape(n, m) / max(now[: n * m].max(), 1e-12)


def correspondences(old: list[tuple[str, str, str]], new: list[tuple[str, str, str]]) -> list[tuple[int, int, float]]:
    """Pairs of fields with their scores, chosen from the top, each field once, among the pairs that agree in type.

    Pairs that agree in value too come first; of the others a pair must have ``FOLLOWED`` of the best score, be the best for
    both of its fields and have names that are ``NAMED_ALIKE``, as where nothing else is left any pair scores best.
    """
    if not old or not new:
        return []
    scores = flood(old, new)
    same_type = np.array([[a[1] == b[1] for b in new] for a in old])
    same = same_type & np.array([[a[2] == b[2] for b in new] for a in old])
    fit = np.where(same_type, scores, 0.0)
    alike = _alike([f[0].rpartition(".")[2] for f in old], [f[0].rpartition(".")[2] for f in new])
    likely = same_type & ~same & (alike >= NAMED_ALIKE) & (fit >= FOLLOWED) & (fit >= fit.max(axis=0)[None, :]) & (fit >= fit.max(axis=1)[:, None])
    order = sorted(zip(*np.nonzero(same | likely)), key=lambda p: (not same[p], -scores[p], p))
    taken_a, taken_b, out = set(), set(), []
    for a, b in order:
        if a not in taken_a and b not in taken_b:
            taken_a.add(a)
            taken_b.add(b)
            out.append((int(a), int(b), float(scores[a, b])))
    return out


def compare(old: list[tuple[str, str, str]], new: list[tuple[str, str, str]]) -> list[tuple[str, str, str, float]]:
    """``(change, field, new_field, score)`` between two flattened files.

    Fields that correspond are ``renamed`` if no other vanished or appeared field has their type and value; other
    correspondences come out as ``followed`` beside the removal and the addition that they are by the letter.
    """
    before, after = {f[0]: f for f in old}, {f[0]: f for f in new}
    out = [("type_changed", p, "", 1.0) for p in before if p in after and before[p][1] != after[p][1]]
    gone, come = [f for f in old if f[0] not in after], [f for f in new if f[0] not in before]
    lost, made = Counter(f[1:] for f in gone), Counter(f[1:] for f in come)
    pairs = correspondences(gone, come)
    exact = {(a, b): s for a, b, s in pairs if gone[a][1:] == come[b][1:] and lost[gone[a][1:]] == 1 == made[come[b][1:]]}
    out += [("renamed", gone[a][0], come[b][0], s) for (a, b), s in exact.items()]
    out += [("followed", gone[a][0], come[b][0], s) for a, b, s in pairs if (a, b) not in exact]
    old_names, new_names = {a for a, _ in exact}, {b for _, b in exact}
    out += [("removed", f[0], "", 0.0) for i, f in enumerate(gone) if i not in old_names]
    return out + [("added", f[0], "", 0.0) for i, f in enumerate(come) if i not in new_names]


def json_streams(sessions: DataFrame, packages: DataFrame) -> DataFrame:
    """``(file_id, station, saved_at, stream, text)``: each file once per stream; null texts and files without an id are left out."""
    streams = [sessions.select("file_id", "station", "saved_at", F.lit(c).alias("stream"), F.col(c).alias("text")) for c in ("detection_params", "pipeline_config")]
    streams.append(packages.select("file_id", "station", "saved_at", F.lit("manifest").alias("stream"), F.col("manifest").alias("text")))
    every = streams[0].unionByName(streams[1]).unionByName(streams[2])
    return every.where("text is not null and file_id is not null").groupBy("file_id", "stream").agg(F.min("station").alias("station"), F.min("saved_at").alias("saved_at"), F.max("text").alias("text"))


def parse(streams: DataFrame) -> DataFrame:
    """``(file_id, station, saved_at, stream, fields)`` of the files with a readable JSON object; others are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fields = [flatten(t) for t in pdf["text"]]
            ok = [f is not None for f in fields]
            if not any(ok):
                continue
            out = pdf.loc[ok, ["file_id", "station", "saved_at", "stream"]].copy()
            out["fields"] = [[{"path": p, "type": t, "value": v} for p, t, v in f] for f in fields if f is not None]
            yield out

    return streams.mapInPandas(read, f"file_id bigint, station string, saved_at timestamp, stream string, fields {FIELDS}")


def _bucket(saved_at: Column) -> Column:
    """Bucket of time; files without a time come before all others."""
    return F.floor(F.coalesce(saved_at.cast("timestamp").cast("long"), F.lit(-(2**40))) / BUCKET_S)


def changes(streams: DataFrame) -> DataFrame:
    """``(file_id, station, saved_at, stream, change, field, new_field, score)``: each file of ``json_streams`` against the one
    before of its station, ``change`` being ``type_changed``, ``renamed``, ``removed``, ``added`` or ``followed`` (see ``compare``).

    Files come in order of ``saved_at`` and then ``file_id``; those without a time first; those without a readable JSON object
    aren't there.  The first file of a station and stream has nothing to differ from.  A station may hold any share of all
    files: Spark sorts the files of a station within buckets of time, a pass over them reads each once and compares it with
    the last one, and of each bucket only the first and the last file meet those of other buckets.  Empty input gives no
    rows; a null station is a station.
    """
    keys = ["stream", "station", "bucket"]
    columns = ["file_id", "station", "saved_at", "stream", "bucket", "change", "field", "new_field", "score"]
    kinds = dict(streams.dtypes)
    schema = f"file_id {kinds['file_id']}, station string, saved_at timestamp, stream string, bucket bigint, change string, field string, new_field string, score double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Changes within each bucket, and for each bucket one row with the texts of its first and last file."""
        place, first, last, last_text = None, None, None, None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                at = (r.stream, r.station, r.bucket)
                if at == place and r.text == last_text:
                    continue
                fields = flatten(r.text)
                if fields is None:
                    continue
                if at != place:
                    if place is not None:
                        rows.append((*first[:5], "", first[5], last_text, 0.0))
                    place, first = at, (r.file_id, r.station, r.saved_at, r.stream, r.bucket, r.text)
                elif fields != last:
                    rows += [(r.file_id, r.station, r.saved_at, r.stream, r.bucket, *c) for c in compare(last, fields)]
                last, last_text = fields, r.text
            yield pd.DataFrame(rows, columns=columns)
        if place is not None:
            yield pd.DataFrame([(*first[:5], "", first[5], last_text, 0.0)], columns=columns)

    def seams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.field != r.before:
                    rows += [(r.file_id, r.station, r.saved_at, r.stream, r.bucket, *c) for c in compare(flatten(r.before), flatten(r.field))]
            yield pd.DataFrame(rows, columns=columns)

    files = streams.withColumn("bucket", _bucket(F.col("saved_at"))).select("file_id", "station", "saved_at", "stream", "bucket", "text")
    found = cut_lineage(files.repartition(*keys).sortWithinPartitions(*keys, "saved_at", "file_id").mapInPandas(work, schema))
    edges = carried(found.where("change = ''"), ["stream", "station"], "bucket", "new_field", "before").where("before is not null")
    every = found.where("change <> ''").unionByName(edges.mapInPandas(seams, schema))
    return every.drop("bucket")


def one_table(parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """All files in one long table: ``file_id, station, saved_at, stream, field, written_as, type, value, doubtful``.

    ``field`` is the first name that the field had in its station; ``written_as`` the name in this file; ``doubtful`` whether
    the last change of its name rests on likeness alone (``followed``), not on the same value.  Chains of renames are followed by doubling,
    until none is left; each round joins the renames only.  A cell finds the last renaming before it within its bucket of
    time, or the one that is carried to there.
    """
    keys = ["stream", "station"]
    at = F.struct("saved_at", "file_id").alias("at")
    renames = changed.where("change in ('renamed', 'followed')").select(*keys, at, F.col("field").alias("old"), F.col("new_field").alias("name"), (F.col("change") == "followed").alias("doubtful"))
    renames = cut_lineage(renames.withColumn("bucket", _bucket(F.col("at.saved_at"))))
    made = renames.select(*keys, "name", "at", "bucket", F.struct("at", "name").alias("id"))
    used = renames.select(*keys, F.col("old").alias("name"), "at", "bucket", F.struct("at", "name").alias("id"), "doubtful")
    links = latest(used, made, [*keys, "name"], "at", "bucket", "id", "parent", equal=False)
    links = cut_lineage(links.select(*keys, "id", "parent", F.col("name").alias("root"), "doubtful"))
    while not links.where("parent is not null").isEmpty():
        up = links.select(*(F.col(k).alias(f"up_{k}") for k in keys), F.col("id").alias("up_id"), F.col("parent").alias("grand"), F.col("root").alias("up_root"))
        on = F.col("stream").eqNullSafe(F.col("up_stream")) & F.col("station").eqNullSafe(F.col("up_station")) & (F.col("parent") == F.col("up_id"))
        links = cut_lineage(links.join(up, on, "left").select(*keys, "id", F.col("grand").alias("parent"), F.coalesce("up_root", "root").alias("root"), "doubtful"))
    roots = links.select(*keys, F.col("id.name").alias("name"), F.col("id.at").alias("at"), _bucket(F.col("id.at.saved_at")).alias("bucket"), F.struct("root", "doubtful").alias("root"))
    cells = parsed.select("file_id", *keys, "saved_at", F.explode("fields").alias("f")).select(
        *keys, F.col("f.path").alias("name"), at, _bucket(F.col("saved_at")).alias("bucket"), F.col("f.type").alias("type"), F.col("f.value").alias("value")
    )
    # most names of most stations never change: their cells stay where they are
    place = F.struct(*keys, "name").alias("place")
    changing = cut_lineage(with_numbers(cells.withColumn("place", place), roots.select(place, F.lit(True).alias("changes")).distinct(), ["place"], "left").drop("place"))
    followed = latest(changing.where("changes").drop("changes"), roots, [*keys, "name"], "at", "bucket", "root", "root")
    kept = changing.where("changes is null").drop("changes").withColumn("root", F.lit(None).cast(followed.schema["root"].dataType))
    return followed.unionByName(kept).select(
        F.col("at.file_id").alias("file_id"),
        "station",
        F.col("at.saved_at").alias("saved_at"),
        "stream",
        F.coalesce("root.root", "name").alias("field"),
        F.col("name").alias("written_as"),
        "type",
        "value",
        F.coalesce("root.doubtful", F.lit(False)).alias("doubtful"),
    )
