"""Generated, minified and vendored files and data blobs, so that hand-written source remains.

Terminals are statements. A Re-Pair grammar over their shapes gives the reuse of a file: without reuse nothing is generated, and
since people repeat themselves too (style sheets, tables of cases), a second sign must tell a tool's repetition from a person's:
statements of one shape that count up (field0001, field0002), a generator's banner, or JSON, where reuse alone decides. Where
most of a text is literals and the grammar over these finds next to nothing to reuse, it is data. Pairs of neighbouring statements are the first rules of a grammar over the whole collection: a file most of
whose pairs also stand in other repositories, and whose pairs as a set are much like those of one file there (equal bands of
minimum hashes), is a copy, patched or not; a passage that many unlike files share makes none of them one. Leading comments with a project's name, version and
licence, or a generator's banner over a body that repeats, settle single copies.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.repair import counters, literal, reuse, shape, statements, values
from treeloom.llm.rolling import mix
from treeloom.llm.syntax import decoded
from treeloom.session import materialize

#: Thresholds: share of counting statements, reuse beside a second sign, reuse of a JSON grammar, share of literal text, most
#: reuse in literals that are data, white space and statement length of minified text, share of pairs known elsewhere.
COUNTING, REUSE, JSON_REUSE, LITERAL, LITERAL_REUSE, WHITE, DENSE, COPIED = 0.4, 0.3, 0.4, 0.6, 0.6, 0.1, 120, 0.6
#: Fewer characters than this are no data block; a pair of statements shorter than this says nothing about its origin.
LEAST_DATA, LEAST_PAIR = 400, 24

_COMMENT = re.compile(r"\s*(//|#|/\*|\*|<!--|;|--|%)")
_LINES = re.compile(r"[\r\n]+")
_BANNER = re.compile(r"@generated|<auto-?generated|\b(code|file|was|is) (is |was )?(auto(matically)?[ -]?)?(generated|produced)\b|auto-?generated|generated\s*[:=]\s*true|generated (by|from|with)\b|do not (edit|modify)|changes will be lost", re.I)
_ORIGIN = re.compile(r"spdx-\w+|@licen[sc]e|@version|upstream|released under|distributed under|licensed under|\(c\) \d{4}|homepage|this file is part of|all rights reserved|permission is hereby granted", re.I)
_MINIFIED_LANGUAGES = {"javascript", "css", "typescript", "json", None}


def head_comment(text: str) -> str:
    """The comment lines that a text begins with, all of them, before any code but a package or shebang line."""
    out, inside = [], False
    for line in _LINES.split(text):
        if not line.strip():
            continue
        if inside or _COMMENT.match(line):
            out.append(line)
            inside = (inside or "/*" in line) and "*/" not in line
        elif not line.startswith(("package ", "'use strict'", '"use strict"')):
            break
    return "\n".join(out)


def judge(text: str, language: str | None) -> str | None:
    """generated, minified, data or vendored by the file alone; None where nothing tells."""
    if not text.strip():
        return None
    st = statements(text)
    size = sum(map(len, st))
    literals = [s for s in st if literal(s)]
    held = sum(map(len, literals))
    if held >= LITERAL * size and held >= LEAST_DATA and reuse(values(literals)) < LITERAL_REUSE:
        return "data"
    lines = [x for x in _LINES.split(text) if x.strip()]
    white = sum(map(len, text.split()))
    if 1 - white / len(text) < WHITE and language in _MINIFIED_LANGUAGES:
        longest = sorted(map(len, lines))[-max(1, len(lines) // 2) :]
        if sum(longest) / len(longest) > DENSE:
            return "minified"
    shapes = [shape(s, language == "json") for s in st]
    head = head_comment(text)
    if language == "json":
        signed, least = True, JSON_REUSE
    else:
        signed, least = counters(st, shapes) >= COUNTING or bool(head and _BANNER.search(head)), REUSE
    if signed and reuse(shapes) >= least:
        return "generated"
    if len({m.lower() for m in _ORIGIN.findall(head)}) >= 2:
        return "vendored"
    return None


def pair_hashes(text: str) -> list[int]:
    """Distinct signed 64-bit hashes of neighbouring statements, trivial ones left out."""
    st = statements(text)
    out = {xxhash.xxh64_intdigest(f"{a}\n{b}".encode("utf-8", "replace")) for a, b in zip(st, st[1:], strict=False) if len(a) + len(b) >= LEAST_PAIR}
    return [h - (1 << 64) if h >> 63 else h for h in out]


#: Bands of minimum hashes: files with nine tenths of their pairs in common agree in one but for 1e-11, with a tenth in 1 of 400.
BANDS, ROWS = 24, 4
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands(pairs: list[int]) -> list[int]:
    """One signed 64-bit hash per band of minimum hashes of a set of pairs."""
    if not pairs:
        return []
    low = mix(np.array(pairs, np.int64).view(np.uint64)[:, None] ^ _SEEDS).min(0).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(31) + low[:, r])
    return out.view(np.int64).tolist()


def machine_made(files: DataFrame) -> DataFrame:
    """(source_file_id, kind) of each file that isn't hand-written: generated, minified, data or vendored.

    files: (source_file_id, language, repository_id, content). Null, empty and blank contents are hand-written; a null language
    counts as unknown; a file without repository is judged by itself and never counts as another repository's copy. Pairs
    are counted over repositories with partial aggregation, so a pair of a third of all files is one row per task.
    """

    def run(batches):
        for b in batches:
            kinds, pairs, sets = [], [], []
            for lang, content in zip(b.column(1).to_pylist(), b.column(3), strict=True):
                text = decoded(content.as_py())
                kind = judge(text, lang)
                kinds.append(kind)
                pairs.append(pair_hashes(text) if kind in (None, "vendored") else [])
                sets.append(bands(pairs[-1]))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(kinds, pa.string()), pa.array(pairs, longs), pa.array(sets, longs)], ["source_file_id", "repository_id", "kind", "pairs", "bands"])

    cols = files.where("source_file_id is not null").select("source_file_id", "language", "repository_id", "content")
    seen = materialize(cols.mapInArrow(run, "source_file_id string, repository_id string, kind string, pairs array<long>, bands array<long>"), "statement-pairs")
    pairs = seen.where("repository_id is not null").select("source_file_id", F.xxhash64("repository_id").alias("repo"), "kind", F.explode("pairs").alias("pair"))
    known = pairs.groupBy("pair").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("pair")
    hits = pairs.where("kind is null").select("source_file_id", "pair").join(known, "pair").groupBy("source_file_id").agg(F.count("*").alias("hits"))
    sizes = seen.where("kind is null").select("source_file_id", F.size("pairs").alias("n")).groupBy("source_file_id").agg(F.sum("n").alias("n"))
    alike = seen.where("repository_id is not null").select("source_file_id", F.xxhash64("repository_id").alias("repo"), "kind", F.explode("bands").alias("band"))
    twins = alike.groupBy("band").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("band")
    twins = alike.where("kind is null").join(twins, "band", "left_semi").select("source_file_id").distinct()
    copies = sizes.join(hits, "source_file_id").join(twins, "source_file_id", "left_semi").where((F.col("n") >= 4) & (F.col("hits") >= COPIED * F.col("n"))).select("source_file_id", F.lit("vendored").alias("kind"))
    alone = seen.where("kind is not null").select("source_file_id", "kind")
    return alone.unionByName(copies).groupBy("source_file_id").agg(F.min("kind").alias("kind"))
