"""Cutting oversized texts at natural boundaries, by byte ranges.

A text is handled in ranges of bytes. A worker gets a range with a halo to its right, finds where the range really
starts and ends (at places where the tokenizer starts anew whatever precedes), and lists the boundaries inside with
the bytes and tokens between them. The tables of a text are stitched by prefix sums, pieces are chosen on numbers
alone, and the piece texts are read by offset. Texts of one range take the same steps inside one task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.tokens import VOCABULARY, Coder, clean_text, shipped, worker_coder
from sievewright.session import broadcast_if_few
from sievewright.session import cut as cut_lineage

#: Bytes of a range and of its halo.
RANGE_BYTES, HALO_BYTES = 32_768, 1_024
#: Bytes of text after which a worker hands on its pieces.
OUTPUT_BYTES = 2_000_000
#: Kinds of boundaries, weakest first.
KINDS = ("inside", "word", "sentence", "line", "paragraph", "end")
#: Longest stretch of tokens without a listed boundary.
STRETCH = 24
#: Shortened words after which a full stop ends no sentence.
SHORT = ("Dr", "Mr", "Mrs", "No", "Nr", "approx", "cf", "e.g", "i.e", "vs", "fig", "z. B", "z.B", "c.-à-d")

_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"""[.!?…]["'”’)\]]*(?=[ \t]+["'“‘(\[]?[A-Z0-9À-ÞΑ-ΩА-Я぀-鿿])""")
_SENTENCE_WIDE = re.compile(r"""[。！？]["'”’）」』]*""")
_SHORT_LAST = {x[-1] for x in SHORT}
_SHORT = re.compile(r"(?:" + "|".join(rf"(?<!\w){re.escape(x)}" for x in SHORT) + r")\.$")
#: Places where the split pattern starts a new word whatever stands before: a blank after a non-blank, or a letter or
#: digit run followed by a character of another kind.
_ANEW = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")


def _edge(data: bytes, at: int) -> int:
    """First character start at or after a byte offset."""
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


def first_anew(data: bytes, at: int) -> int:
    """Byte offset of the first place at or after ``at`` where tokenizing can start anew.

    Only bytes from one character before ``at`` to the end of the halo are looked at, so both neighbours of a range
    border find the same place. Without one in the halo the border itself is taken.
    """
    if at <= 0:
        return 0
    at = _edge(data, at)
    if at >= len(data):
        return len(data)
    before = at - 1
    while before > 0 and 0x80 <= data[before] < 0xC0:
        before -= 1
    stop = _edge(data, min(len(data), at + HALO_BYTES))
    view = data[before:stop].decode("utf-8", "replace")
    skip = 1
    found = _ANEW.search(view, skip)
    if not found:
        return at
    return before + len(view[: found.start()].encode())


def token_ends(text: str, code: Coder) -> np.ndarray:
    """Byte at which every token of a text ends."""
    return np.cumsum(code.lengths[np.array(code.encode(text), np.int64)]) if text else np.zeros(0, np.int64)


def _ends_short(text: str, at: int) -> bool:
    """Whether the full stop at a place belongs to a shortened word."""
    return text[at] == "." and text[at - 1 : at] in _SHORT_LAST and _SHORT.search(text, max(0, at - 8), at + 1) is not None


def boundaries(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, tokens and kind at each boundary of a text, its end included.

    Bytes and tokens count from the start of the text. All listed places are ends of tokens and of characters. ``ends``:
    as of ``token_ends``.
    """
    data = text.encode()
    places = [m.end() for m in _SENTENCE.finditer(text) if not _ends_short(text, m.start())]
    if "。" in text or "！" in text or "？" in text:
        places += [m.end() for m in _SENTENCE_WIDE.finditer(text)]
    kinds = [2] * len(places)
    for m in _LINE.finditer(text):
        a, b = m.span()
        if text[b - 1] == "\n" and b < len(text):
            places.append(b)
        else:  # a run of blanks that ends a line belongs to the piece before, unless it indents the next line
            while a and text[a - 1].isspace():
                a -= 1
            places.append(a)
        kinds.append(4 if text.count("\n", a, b) > 1 else 3)
    at, kind = np.array(places, np.int64), np.array(kinds, np.int8)
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[at]
    total = len(ends)
    at, kind, token = _real(at, kind, ends)
    # long stretches get the ends of words, and where there are none, ends of tokens
    edges = np.concatenate([[0], token, [total]])
    wide = np.flatnonzero(np.diff(edges) > STRETCH)
    if len(wide):
        raw = np.frombuffer(data, np.uint8)
        blank = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
        words, _, word_token = _real(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, None, ends)
        stretch = edges.searchsorted(word_token) - 1
        long = np.zeros(len(edges), bool)
        long[wide] = True
        inside = long[stretch] & (word_token != edges[np.minimum(stretch + 1, len(edges) - 1)])
        at, kind, token = np.concatenate([at, words[inside]]), np.concatenate([kind, np.ones(inside.sum(), np.int8)]), np.concatenate([token, word_token[inside]])
        order = np.argsort(token, kind="stable")
        at, kind, token = at[order], kind[order], token[order]
        edges = np.concatenate([[0], token, [total]])
        marks = [t for j in np.flatnonzero(np.diff(edges) > STRETCH) for t in range(int(edges[j]) + STRETCH // 2, int(edges[j + 1]), STRETCH // 2)]
        if marks:
            more = np.array(marks, np.int64)
            where = ends[more - 1]
            whole = (where < len(data)) & ((raw[np.minimum(where, len(data) - 1)] & 0xC0) != 0x80)
            at, kind, token = np.concatenate([at, where[whole]]), np.concatenate([kind, np.zeros(whole.sum(), np.int8)]), np.concatenate([token, more[whole]])
            order = np.argsort(token, kind="stable")
            at, kind, token = at[order], kind[order], token[order]
    return np.append(at, len(data)), np.append(token, total), np.append(kind, 5)


def _real(at: np.ndarray, kind: np.ndarray | None, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places that are ends of tokens inside the text, in order and once each (the strongest kind), with their token counts."""
    kind = np.zeros(len(at), np.int8) if kind is None else kind
    if not len(ends) or not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.int8), none
    order = np.lexsort((-kind, at))
    at, kind = at[order], kind[order]
    index = ends.searchsorted(at)
    real = (at > 0) & (index < len(ends) - 1) & (ends[np.minimum(index, len(ends) - 1)] == at)
    real[1:] &= at[1:] != at[:-1]
    return at[real], kind[real], index[real] + 1


def choose(token: np.ndarray, kind: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces of a text: first token, boundary at or before it, end boundary and kind of the end.

    ``token`` and ``kind`` list the boundaries with the end of the text last. A piece ends at the strongest
    boundary in the second half of the room it has, the last of equals; the next one starts ``overlap`` tokens before.
    A text within the limit gives no pieces.
    """
    total = int(token[-1])
    out: list[tuple[int, int, int, int]] = []
    if total <= most:
        return out
    at = token.tolist()
    start, done = 0, 0
    while True:
        base = bisect_right(at, start) - 1
        if total - start <= most:
            out.append((start, base, len(at) - 1, 5))
            return out
        lo = bisect_left(at, max(start + most // 2, done + 1))
        hi = bisect_right(at, start + most)
        if lo >= hi:
            lo = bisect_left(at, done + 1)
            hi = max(hi, lo + 1)
        ks = kind[lo:hi]
        end = hi - 1 - int(ks[::-1].argmax())
        out.append((start, base, end, int(kind[end])))
        done = at[end]
        start = max(done - overlap, start + 1) if overlap else done


def _aligned(view: bytes, ends: np.ndarray, skip: int, code: Coder) -> int:
    """Byte after ``skip`` tokens of a text whose tokens end at ``ends``.

    Moved back to the start of a character, and forward while the rest of a cut word alone would take more tokens than
    it does in the text.
    """
    for s in range(skip, min(skip + 8, len(ends))):
        e = int(ends[s - 1])
        while e > 0 and e < len(view) and 0x80 <= view[e] < 0xC0:
            e -= 1
        if e >= len(view) or view[e] in b" \n\r\t":
            return e
        rest = view[e : e + 120].decode("utf-8", "ignore")
        anew = _ANEW.search(rest, 1)
        word = rest[: anew.start()] if anew else rest
        if code.count(word) <= int(ends.searchsorted(e + len(word.encode()), "right")) - s:
            return e
    e = int(ends[skip - 1])
    while e > 0 and e < len(view) and 0x80 <= view[e] < 0xC0:
        e -= 1
    return e


def start_byte(data: bytes, base: int, skip: int, code: Coder) -> int:
    """Byte at which a piece starts that skips ``skip`` tokens from the boundary at byte ``base``."""
    if not skip:
        return base
    for size in (16 * skip + 128, 64 * skip + 256):
        view = data[base : base + size]
        view = view[: len(view) - _torn(view)] if base + len(view) < len(data) else view
        ids = code.encode(view.decode("utf-8", "ignore"))
        if len(ids) >= skip + 16 or base + len(view) >= len(data):
            break
    ends = np.cumsum(code.lengths[np.array(ids, np.int64)]) if ids else np.zeros(1, np.int64)
    return base + _aligned(view, ends, min(skip, len(ends)), code)


def _torn(view: bytes) -> int:
    """Bytes of an incomplete last character."""
    for n in range(1, min(4, len(view)) + 1):
        b = view[-n]
        if b >= 0xC0:
            return n if n < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        if b < 0x80:
            return 0
    return 0


_PIECE = "setting string, doc_id long, piece int, start_byte long, end_byte long, tokens int, boundary string, text string"


def _limits(limits: DataFrame) -> list[tuple[str, int, int]]:
    rows = limits.where("purpose = 'piece' and max_tokens > 0").select("setting", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")).distinct().collect()
    out = sorted((r["setting"], int(r["max_tokens"]), int(r["overlap_tokens"])) for r in rows)
    for name, most, overlap in out:
        if most < 4 * STRETCH or not 0 <= overlap <= most // 4:
            raise ValueError(f"setting {name}: needs max_tokens of at least {4 * STRETCH} and an overlap of at most a quarter")
    return out


def pieces(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ordered pieces of all texts longer than a limit, for every setting of ``limits``.

    ``limits``: rows of ``purpose`` piece with ``setting``, ``max_tokens`` and ``overlap_tokens`` (null is 0). Returns
    setting, doc_id, piece (from 0), start_byte and end_byte (of the UTF-8 text), tokens (of the piece as a text of its
    own), boundary (what the piece ends at) and text. Pieces end at paragraphs, lines, sentences or words, and inside a word only where a text has no
    other boundary for long; consecutive pieces share ``overlap_tokens`` tokens (a little more or less where that
    place lies inside a character or word). Null texts and texts within a limit give no pieces. ``doc_id`` must be
    unique.
    """
    settings = _limits(limits)
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    short = rows.where(F.octet_length("text") <= range_bytes)

    name = shipped(documents.sparkSession, vocabulary)

    def direct(batches: Iterator[pa.RecordBatch]):
        code = worker_coder(name)
        for batch in batches:
            out, size = [], 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if size > OUTPUT_BYTES:
                    yield _batch(out)
                    out, size = [], 0
                if not raw or len(raw) * 4 <= settings_least:
                    continue
                text = clean_text(raw)
                data = text.encode()
                if len(data) <= settings_least:
                    continue
                ends = token_ends(text, code)
                if len(ends) <= settings_least:
                    continue
                at, token, kind = boundaries(text, ends)
                out += _cut(doc, data, at, token, kind, ends, settings, code)
                size += len(data) * len(settings)
            if out:
                yield _batch(out)

    settings_least = min((m for _, m, _ in settings), default=0)  # a token has at least one byte
    done = short.mapInArrow(direct, _PIECE)
    long = rows.where(F.octet_length("text") > range_bytes).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    stitched = _stitched(long, settings, vocabulary, range_bytes)
    return done.unionByName(stitched)


_ARROW = pa.schema([("setting", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("tokens", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])


def _batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


_BLANK = b" \n\t\r"


def _blank_after_word(data: bytes, at: int) -> bool:
    """Whether a blank that follows none stands at a byte: tokenizing starts anew there whatever precedes."""
    return data[at] in _BLANK and 0x20 < data[at - 1] < 0x7F


def exact_tokens(data: bytes, s: int, e: int, ends: np.ndarray, code: Coder) -> int:
    """Tokens of the bytes from ``s`` to ``e`` as a text of their own, given the tokens of the whole text.

    Between the first and the last place where tokenizing starts anew both texts have the same tokens; only what stands
    before and behind is encoded again.
    """
    head = s
    if s and not (_blank_after_word(data, s) or (data[s - 1] == 10 and data[s] > 0x20 and data[s] < 0x7F)):
        view = data[s : min(e, s + 256)]
        view = view[: len(view) - _torn(view)].decode("utf-8", "ignore")
        found = _ANEW.search(view, 1)
        head = s + len(view[: found.start()].encode()) if found else e
    tail = e
    if e < len(data) and not _blank_after_word(data, e):
        while tail > head and data[tail - 1] in _BLANK:
            tail -= 1
        if tail == e or (tail > head and not _blank_after_word(data, tail)):
            begin = _edge(data, max(head, e - 256))
            view = data[begin:e].decode("utf-8", "ignore")
            last = None
            for last in _ANEW.finditer(view, 1):
                pass
            tail = begin + len(view[: last.start()].encode()) if last else head
    if tail <= head:
        return code.count(data[s:e].decode("utf-8", "ignore"))
    inside = int(ends.searchsorted(tail, "right") - ends.searchsorted(head, "right"))
    return inside + (code.count(data[s:head].decode("utf-8", "ignore")) if head > s else 0) + (code.count(data[tail:e].decode("utf-8", "ignore")) if tail < e else 0)


def _cut(doc: int, data: bytes, at: np.ndarray, token: np.ndarray, kind: np.ndarray, ends: np.ndarray, settings: list, code: Coder) -> list[tuple]:
    out = []
    for name, most, overlap in settings:
        for n, (start, base, end, k) in enumerate(choose(token, kind, most, overlap)):
            exact = not start or (base >= 0 and int(token[base]) == start)
            s, e = (int(ends[start - 1]) if start else 0) if exact else _aligned(data, ends, start, code), int(at[end])
            out.append((name, doc, n, s, e, exact_tokens(data, s, e, ends, code), KINDS[k], data[s:e].decode("utf-8", "ignore")))
    return out


def _stitched(long: DataFrame, settings: list, vocabulary: str, range_bytes: int) -> DataFrame:
    """Pieces of texts of several ranges: boundary tables by range, stitched by prefix sums, texts by offset.

    ``long``: doc_id, data. Only the ranges leave their rows for the tables, and only the pieces for the texts; what
    is joined to the texts are numbers, which are broadcast where they are few.
    """
    size = F.octet_length("data")
    ranges = long.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / range_bytes))).alias("n"), size.alias("size"), "data")
    part = F.expr("substring(data, cast(begin + 1 as int), cast(length as int))")
    ranges = _spans(ranges, range_bytes).select("doc_id", "n", "size", "begin", part.alias("part"))
    chosen = cut_lineage(_chosen(ranges, settings, vocabulary, range_bytes))
    part = F.expr("substring(data, cast(origin + 1 as int), cast(end_byte - origin as int))")
    spans = long.join(broadcast_if_few(chosen, chosen.count(), 120), "doc_id").select("setting", "doc_id", "piece", "origin", "skip", "end_byte", "boundary", part.alias("part"))
    return _emitted(spans, vocabulary)


def _spans(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges with the first byte and the number of bytes that a worker needs: a few bytes before, and the halo behind."""
    lead = 8  # enough for the character that precedes
    begin = F.greatest(F.col("n") * range_bytes - lead, F.lit(0))
    return ranges.withColumn("begin", begin).withColumn("length", F.least(F.col("size") - F.col("begin"), F.lit(range_bytes + lead + 2 * HALO_BYTES)))


def file_pieces(files: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, range_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of text files of any size, as of ``pieces``, without loading a file as a whole.

    ``files``: doc_id, path (of a file system that pyarrow opens and all executors reach), size in bytes; UTF-8. Workers
    open a file and read their range, and later their piece, by offset. Only the boundary table of a file is held by
    one task. Null paths and empty files give no pieces.
    """
    settings = _limits(limits)
    known = files.select("doc_id", "path", "size").where("doc_id is not null and path is not null and size > 0")
    each = known.select("doc_id", "path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / range_bytes))).alias("n"))
    ranges = _read(_spans(each, range_bytes).repartition("doc_id", "n"), ["doc_id", "n", "size", "begin"], "begin", "length")
    chosen = cut_lineage(_chosen(ranges, settings, vocabulary, range_bytes))
    spans = chosen.withColumn("length", F.col("end_byte") - F.col("origin")).join(known.select("doc_id", "path"), "doc_id").repartition("doc_id", "setting", "piece")
    return _emitted(_read(spans, ["setting", "doc_id", "piece", "origin", "skip", "end_byte", "boundary"], "origin", "length"), vocabulary)


def _read(spans: DataFrame, keep: list[str], begin: str, length: str) -> DataFrame:
    """Rows with the bytes of their file from ``begin`` on as ``part``."""

    def read(batches: Iterator[pd.DataFrame]):
        from pyarrow.fs import FileSystem, LocalFileSystem

        opened: dict[str, object] = {}
        for pdf in batches:
            parts = []
            for path, at, n in zip(pdf["path"], pdf[begin].tolist(), pdf[length].tolist(), strict=True):
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    system, name = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)
                    opened = {path: system.open_input_file(name)}
                parts.append(opened[path].read_at(n, at))
            yield pdf[keep].assign(part=parts)
        for f in opened.values():
            f.close()

    types = {f.name: f.dataType.simpleString() for f in spans.schema}
    return spans.mapInPandas(read, ", ".join(f"{c} {types[c]}" for c in keep) + ", part binary")


def _chosen(ranges: DataFrame, settings: list, vocabulary: str, range_bytes: int) -> DataFrame:
    """Pieces as numbers, from ranges of texts (doc_id, n, size, begin, part): boundary tables, stitched by prefix sums."""

    name = shipped(ranges.sparkSession, vocabulary)

    def tables(batches: Iterator[pd.DataFrame]):
        code = worker_coder(name)
        for pdf in batches:
            out = []
            for doc, n, whole, begin, part in zip(pdf["doc_id"].tolist(), pdf["n"].tolist(), pdf["size"].tolist(), pdf["begin"].tolist(), pdf["part"], strict=True):
                part = bytes(part)
                lo = first_anew(part, n * range_bytes - begin)
                hi = first_anew(part, (n + 1) * range_bytes - begin) if (n + 1) * range_bytes < whole else len(part)
                if hi <= lo:
                    continue
                text = part[lo:hi].decode("utf-8", "ignore")
                at, token, kind = boundaries(text, token_ends(text, code))
                out.append((doc, n, begin + lo, at.tolist(), token.tolist(), kind.tolist(), whole))
            yield pd.DataFrame(out, columns=["doc_id", "n", "origin", "at", "token", "kind", "size"])

    listed = ranges.mapInPandas(tables, "doc_id long, n long, origin long, at array<long>, token array<int>, kind array<int>, size long")
    ordered = listed.repartition("doc_id").sortWithinPartitions("doc_id", "n")

    def stitch(batches: Iterator[pd.DataFrame]):
        last, parts = None, []

        def finish():
            at = np.concatenate([o + np.asarray(a) for o, a, _, _ in parts])
            counts = [int(t[-1]) for _, _, t, _ in parts]
            before = np.concatenate([[0], np.cumsum(counts)])
            token = np.concatenate([b + np.asarray(t) for b, (_, _, t, _) in zip(before, parts, strict=False)])
            kind = np.concatenate([np.asarray(k) for _, _, _, k in parts])
            kind[:-1][kind[:-1] == 5] = 1  # the end of a range is the end of a word
            rows = []
            for name, most, overlap in settings:
                for n, (start, base, end, k) in enumerate(choose(token, kind, most, overlap)):
                    origin, known = (int(at[base]), int(token[base])) if base >= 0 else (0, 0)
                    rows.append((last, name, n, origin, start - known, int(at[end]), int(token[end]) - start, KINDS[k]))
            return pd.DataFrame(rows, columns=["doc_id", "setting", "piece", "origin", "skip", "end_byte", "tokens", "boundary"])

        for pdf in batches:
            for doc, origin, at, token, kind in zip(pdf["doc_id"].tolist(), pdf["origin"].tolist(), pdf["at"], pdf["token"], pdf["kind"], strict=True):
                if doc != last and parts:
                    yield finish()
                    parts = []
                last = doc
                parts.append((origin, at, token, kind))
        if parts:
            yield finish()

    return ordered.mapInPandas(stitch, "doc_id long, setting string, piece int, origin long, skip int, end_byte long, tokens int, boundary string").drop("tokens")


def _emitted(spans: DataFrame, vocabulary: str) -> DataFrame:
    """Pieces with their texts: ``part`` has the bytes from the boundary at ``origin`` to the end of the piece."""

    name = shipped(spans.sparkSession, vocabulary)

    def emit(batches: Iterator[pd.DataFrame]):
        code = worker_coder(name)
        for pdf in batches:
            starts, texts, tokens = [], [], []
            for origin, skip, part in zip(pdf["origin"].tolist(), pdf["skip"].tolist(), pdf["part"], strict=True):
                data = bytes(part)
                s = start_byte(data, 0, skip, code)
                starts.append(origin + s)
                texts.append(data[s:].decode("utf-8", "ignore"))
                tokens.append(code.count(texts[-1]))
            yield pd.DataFrame({"setting": pdf["setting"], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start_byte": np.array(starts, np.int64), "end_byte": pdf["end_byte"], "tokens": np.array(tokens, np.int32), "boundary": pdf["boundary"], "text": texts})

    return spans.mapInPandas(emit, _PIECE)


def piece_report(cut: DataFrame) -> DataFrame:
    """Texts, pieces and tokens per setting and kind of boundary."""
    return cut.groupBy("setting", "boundary").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"))
