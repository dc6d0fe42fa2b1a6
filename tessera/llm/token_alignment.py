"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often pairs do so.

Every text, with a space before it, is encoded by a byte-level BPE (A) and a piece model with byte fallback (B). Byte
offsets where tokens of both end cut a text into groups; two tokens whose byte ranges overlap are a link. How often a
pair of ids is linked in the whole corpus, and which pairs are the most frequent of their B id, is counted by postings:

* Texts are cut at spaces that follow a letter, where neither tokenizer ever joins; what lies between is encoded
  once and remembered by the process (``REMEMBERED`` entries at most). A text's tokens, groups and links are those of
  its parts.
* Postings are the multiplicities of a document's id pairs. A task gathers those of some thousand documents in a
  pack and cuts it into tiles by B id; a pack's tile is one row, compressed.
* Counts of pairs are summed in each task first, then over all. Tiles are salted by their number of postings, so that
  a frequent id is split; each salt gets the counts of its tile and its packs as one sorted stream, which Spark
  spills as it must: it finds the maximum of each B id, then every pack's contributions by document.
* Contributions are summed by document: a pack's rows of all tiles are added up as vectors.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
``groups_sha256``. Special tokens' strings are plain text. Repeated rows and rows with equal or null ids are documents
of their own. Very long texts are whole. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, drop, stored, text_bytes

TILES = 32
PACK_LINKS, PACK_DOCS = 1 << 20, 1 << 16
SALT_POSTINGS = 1 << 20  # of a tile's salt, about
REMEMBERED = 300_000

#: White space as the first tokenizer's pattern has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_SPACE}]) ")
_ENDS_IN_SPACE = re.compile(f"(?:^|[{_SPACE}])$")
_ALIGNERS: dict = {}


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def _byte_level(piece: str) -> bytes:
    """Bytes of a byte-level piece: printable characters stand for themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return bytes(table[c] for c in piece)


class Aligner:
    """Encoders of both vocabularies and what they gave for the parts seen so far.

    files: of A for `tokenizers`, of A's ranks for `tiktoken` or None, of B. With ranks the same ids come faster.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pieces: str):
        import sentencepiece

        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.encode_a, a_bytes = lambda texts: list(map(fast.encode_ordinary, texts)), {i: b for b, i in table.items()}
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(vocabulary)
            slow.encode_special_tokens = True
            special = set(slow.get_added_tokens_decoder())
            self.encode_a = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
            a_bytes = {i: _byte_level(p) for p, i in slow.get_vocab().items() if i not in special}
        sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        kinds = range(sp.get_piece_size())
        b_bytes = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in kinds]
        #: B may be cut before a space if no piece goes on with one.
        self.parts = not any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in kinds)
        lone = [sp.piece_to_id("▁")]
        self.encode_b = lambda texts: [ids or lone for ids in sp.encode(texts, num_threads=1)]
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = b_bytes
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, b_bytes)), np.int64)
        if max(len(self.a_bytes), len(b_bytes)) > 1 << 16:
            raise ValueError("ids have 16 bits at most")
        self.index: dict[str, int] = {}
        self.known: list[str] = []
        self.groups: list[bytes] = []
        self.numbers = np.zeros((0, 6), np.int64)  # tokens of A, of B, groups, links, ends in a space, isn't given back
        self.codes, self.from_ = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the first REMEMBERED parts; frequent ones come early."""
        if len(self.known) > REMEMBERED:
            for x in self.known[REMEMBERED:]:
                del self.index[x]
            del self.known[REMEMBERED:], self.groups[REMEMBERED:]
            self.numbers, self.from_ = self.numbers[:REMEMBERED], self.from_[: REMEMBERED + 1]
            self.codes = self.codes[: self.from_[-1]]

    def learn(self, new: list[str]) -> None:
        """Encode parts and align them; part x stands for the text ' ' + x."""
        spaced = [" " + x for x in new]
        a, b = self.encode_a(spaced), self.encode_b(new)
        raw = [x.encode() for x in spaced]
        bad = np.array([b"".join(map(self.a_bytes.__getitem__, i)) != t or b"".join(map(self.b_bytes.__getitem__, j)) != t for i, j, t in zip(a, b, raw, strict=True)])
        a, b = ([[] if x else ids for ids, x in zip(side, bad, strict=True)] for side in (a, b))
        n_a, n_b = (np.array(list(map(len, side)), np.int64) for side in (a, b))
        a, b = (np.fromiter((i for ids in side for i in ids), np.int64) for side in (a, b))
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        cuts, links = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, links), np.searchsorted(end_b, links)
        to = end_a[np.cumsum(n_a) - 1] if len(end_a) else np.zeros(len(new), np.int64)
        to[np.cumsum(n_a) == 0] = 0
        from_ = np.searchsorted(links, to, "right")
        n_groups = np.diff(np.searchsorted(cuts, to, "right"), prepend=0)
        text, at = self._listing(a, b, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b))
        token_to = at[np.cumsum(n_a) + np.cumsum(n_b)]
        self.groups += [text[x : max(x, y - 1)] for x, y in zip(np.append(0, token_to[:-1]).tolist(), token_to.tolist(), strict=True)]
        spaces = [bool(_ENDS_IN_SPACE.search(x)) for x in new]
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, np.diff(from_, prepend=0), spaces, bad], 1)])
        self.codes = np.concatenate([self.codes, (b[j] << 16 | a[i]).astype(np.uint32)])
        self.from_ = np.concatenate([self.from_, self.from_[-1] + from_])
        self.index.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.known += new

    @staticmethod
    def _listing(a, b, group_a, group_b):
        """The groups as 'a1,a2|b1;' and so on, and where each token's decimals begin in it, A before B in a group."""
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[np.append(group_a[1:] != group_a[:-1], True)[: len(a)]]] = ord("|")
        mark[place_b[np.append(group_b[1:] != group_b[:-1], True)[: len(b)]]] = ord(";")
        cells = np.zeros((len(ids), 6), np.uint8)
        for d in range(5):
            cells[:, d] = ids // 10 ** (4 - d) % 10 + ord("0")
        cells[:, 5] = mark
        width = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000)
        return cells[np.arange(6) >= (5 - width)[:, None]].tobytes(), np.append(0, np.cumsum(width + 1))

    def lookup(self, parts: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*parts) - self.index.keys()
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.index.__getitem__, p), np.int64, len(p)) for p in parts]

    def parts_of(self, texts: list[str]) -> list[np.ndarray]:
        """Parts of each text, by number; none for texts that are empty or not given back."""
        self.forget()
        found = self.lookup([x.split(" ") if self.parts and x else [x] * (x != "") for x in texts])
        found = self._again(texts, found, [self.numbers[p[:-1], 4].any() for p in found], _CUT.split)  # a space after white space
        found = self._again(texts, found, [len(p) > 1 and self.numbers[p, 5].any() for p in found], lambda x: [x])
        return [p[:0] if self.numbers[p, 5].any() else p for p in found]

    def _again(self, texts, found, which, cut):
        odd = [d for d, x in enumerate(which) if x]
        for d, p in zip(odd, self.lookup([cut(texts[d]) for d in odd]), strict=True):
            found[d] = p
        return found


def aligner(files: tuple[str, str | None, str]) -> Aligner:
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


# ---- documents and packs -------------------------------------------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(x) for x in arrays], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.astype(np.uint32).tobytes() for x in arrays))


def _unsqueeze(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)
    return np.split(flat[n:], np.cumsum(flat[: n - 1]))


class _Pack:
    """Links of a task's next documents."""

    def __init__(self, pack: int):
        self.id, self.docs, self.links, self.size = pack, 0, [], 0

    def add(self, codes: np.ndarray, doc: np.ndarray) -> None:
        """Links of the pack's documents, in order of tile, pair and document when sorted."""
        tile = (codes >> np.uint32(16)).astype(np.uint64) % np.uint64(TILES)
        self.links.append(tile << np.uint64(48) | codes.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64))
        self.size += len(codes)
        if len(codes) > 4 * PACK_LINKS:
            self.links = [np.concatenate(self.links)]

    def tiles(self):
        """(tile, postings, payload): the pairs' codes, postings of each, their documents and multiplicities."""
        keys, times = np.unique(np.concatenate([*self.links, np.zeros(0, np.uint64)]), return_counts=True)
        at = np.searchsorted(keys, np.arange(TILES + 1, dtype=np.uint64) << np.uint64(48)).tolist()
        for tile, (i, j) in enumerate(zip(at, at[1:], strict=False)):
            if i < j:
                code = (keys[i:j] >> np.uint64(16)).astype(np.uint32)  # without the tile
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                doc = (keys[i:j] & np.uint64(0xFFFF)).astype(np.int64)
                gap = np.diff(doc, prepend=0)
                gap[first] = doc[first]
                yield tile, j - i, _squeeze(code[first], np.diff(np.append(first, j - i)), gap, times[i:j])


def _postings(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first posting of each code, documents, multiplicities)."""
    code, runs, gap, times = _unsqueeze(payload, 4)
    first = np.append(0, np.cumsum(runs[:-1], dtype=np.int64))
    total = np.cumsum(gap, dtype=np.int64)
    return code, first, total - np.repeat(total[first] - gap[first], runs), times


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _describe(files, id_type: pa.DataType):
    """Rows of documents (tile -1: uid, id, numbers, hash) and of the tiles of packs (pack, postings, payload)."""
    names = ["tile", "uid", "id", *_NUMBERS, "groups_sha256", "pack", "postings", "payload"]

    def run(batches):
        tool, task, packs = aligner(files), TaskContext.get().partitionId(), 0
        pack = _Pack(task << 24)

        def full():
            nonlocal pack, packs
            rows = list(pack.tiles())
            packs += 1
            old, pack = pack.id, _Pack(task << 24 | packs)
            n = len(rows)
            none = [pa.nulls(n, t) for t in (pa.int64(), id_type, *[pa.int64()] * 4, pa.string())]
            cols = [pa.array([r[0] for r in rows], pa.int32()), *none, pa.array([old] * n, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for i, j in blocks(offs, 1 << 20):
                i_ = i
                while i_ < j:
                    j_ = min(j, i_ + PACK_DOCS - pack.docs)
                    n = j_ - i_
                    parts = tool.parts_of([bytes(data[offs[d] : offs[d + 1]]).decode() for d in range(i_, j_)])
                    flat, count = np.concatenate(parts), np.array(list(map(len, parts)))
                    doc = np.repeat(np.arange(n), count)
                    sums = np.zeros((n, 4), np.int64)
                    if len(flat):
                        some = count > 0
                        sums[some] = np.add.reduceat(tool.numbers[flat, :4], (np.cumsum(count) - count)[some])
                    for lo in range(0, len(flat), PACK_LINKS):  # a very long text in steps
                        p = flat[lo : lo + PACK_LINKS]
                        links = tool.numbers[p, 3]
                        at = np.arange(links.sum()) + np.repeat(tool.from_[p] - (np.cumsum(links) - links), links)
                        pack.add(tool.codes[at], np.repeat(doc[lo : lo + PACK_LINKS] + pack.docs, links))
                    sha = [hashlib.sha256(b";".join(map(tool.groups.__getitem__, p.tolist()))).hexdigest() if len(p) else "" for p in parts]
                    uid = (pack.id << 16) + pack.docs + np.arange(n)
                    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(uid), batch.column(0).slice(i_, n), *[pa.array(c) for c in sums.T], pa.array(sha, pa.string()), *none], names=names)
                    pack.docs += n
                    if pack.docs == PACK_DOCS or pack.size >= PACK_LINKS:
                        yield full()
                    i_ = j_
        if pack.size:
            yield full()

    return run


def _pair_sums(batches):
    """How often a task's packs link each pair, summed once more when many have come."""
    held, size = [], 0

    def summed():
        code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        code, at = np.unique(code, return_inverse=True)
        out = np.zeros(len(code), np.int64)
        np.add.at(out, at, n)
        return code, out

    def rows(code, n):
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    for batch in batches:
        for payload in batch.column(0):
            code, first, _, times = _postings(payload.as_buffer())
            held.append((code.astype(np.int64), np.add.reduceat(times.astype(np.int64), first)))
            size += len(code)
            if size > 1 << 22:
                held = [summed()]
                size = len(held[0][0])
                if size > 1 << 21:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*summed())


def _contributions(batches):
    """Of streams sorted by tile, salt and kind: a pack's documents' links to best pairs, and sums of counts.

    A tile's counts come first; of these the most frequent of each B id are found, then packs follow one by one.
    """
    at, codes, ns, count, best = None, [], [], None, None
    for batch in batches:
        tile, salt, code, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        kind = np.asarray(batch.column(5).is_valid())
        key = tile.astype(np.int64) << 40 | salt
        for i, j in _runs(key * 2 + kind):
            if at != key[i]:
                at, codes, ns = key[i], [], []
            if not kind[i]:
                codes.append(code[i:j].astype(np.int64))
                ns.append(n[i:j].astype(np.int64))
                count = None
                continue
            if count is None:
                known, count = np.concatenate(codes), np.concatenate(ns)
                side = known >> 16
                first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
                most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(side))))
                best = count == most
            for r in range(i, j):
                pair, first, doc, times = _postings(batch.column(5)[r].as_buffer())
                place = np.repeat(np.searchsorted(known, pair), np.diff(np.append(first, len(doc))))
                size = int(doc.max()) + 1
                n_best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(n_best, doc, best[place] * times.astype(np.int64))
                np.add.at(total, doc, count[place] * times.astype(np.int64))
                held = np.flatnonzero(total)
                out = zstandard.ZstdCompressor(level=1).compress(np.stack([held, n_best[held], total[held]]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(4).slice(r, 1), pa.array([out], pa.binary())], names=["pack", "sums"])


def _runs(key: np.ndarray):
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() if len(key) else []
    return zip(cut, [*cut[1:], len(key)], strict=True)


def _by_document(batches):
    """Sums of each pack's rows, which follow each other, as a row for each document."""
    at, sums = None, np.zeros((2, PACK_DOCS), np.int64)

    def rows():
        doc = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array((at << 16) + doc), *[pa.array(s[doc]) for s in sums]], names=["doc", "n_best", "count_sum"])

    for batch in batches:
        for r, pack in enumerate(batch.column(0).to_pylist()):
            if at != pack:
                if at is not None:
                    yield rows()
                at = pack
                sums[:] = 0
            held = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(1)[r].as_buffer()), np.int64).reshape(3, -1)
            sums[:, held[0]] += held[1:]
    if at is not None:
        yield rows()


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str | None, str] | None = None) -> DataFrame:
    """A row for each text: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_sql, id_type = dict(rows.dtypes)["id"], pa.schema(rows.select("id").limit(0).toArrow().schema).field(0).type
    all_ = stored(rows.mapInArrow(_describe(files or default_files(), id_type), f"tile int, uid bigint, id {id_sql}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pack bigint, postings bigint, payload binary"), "align-packs")
    packs = all_.where("tile >= 0")
    counts = stored(packs.select("payload").mapInArrow(_pair_sums, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "align-counts")
    salts = packs.groupBy("tile").agg(F.ceil(F.sum("postings") / SALT_POSTINGS).cast("int").alias("salts"))  # a row for each tile
    tile = F.pmod(F.shiftright("code", 16), F.lit(TILES)).cast("int")
    counted = counts.withColumn("tile", tile).join(F.broadcast(salts), "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "code", "n", F.lit(None).cast("long").alias("pack"), F.lit(None).cast("binary").alias("payload"))
    dealt = packs.join(F.broadcast(salts), "tile").select("tile", F.pmod(F.xxhash64("pack"), "salts").cast("int").alias("salt"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("n"), "pack", "payload")
    streams = counted.union(dealt).repartition("tile", "salt").sortWithinPartitions("tile", "salt", F.col("pack").asc_nulls_first(), "code")
    sums = stored(streams.mapInArrow(_contributions, "pack bigint, sums binary"), "align-sums")
    by_doc = stored(sums.repartition("pack").sortWithinPartitions("pack").mapInArrow(_by_document, "doc bigint, n_best bigint, count_sum bigint"), "align-docs")
    drop(counts, sums)
    docs = all_.where("tile < 0").join(by_doc, F.col("uid") == F.col("doc"), "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return docs.select(F.col("id").alias(id_col), *_NUMBERS, *none, "groups_sha256")
