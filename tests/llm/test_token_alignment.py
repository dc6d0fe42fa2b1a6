"""Cross-tokenizer alignment against whole texts encoded by the two libraries and pairs counted one by one."""

import collections
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import token_alignment as T  # noqa: E402

FILES = [P.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


def plain(texts):
    a_tool, b_tool = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    a_tool.encode_special_tokens = True
    a_bytes = {i: T._byte_level(p) for p, i in a_tool.get_vocab().items()}
    b_bytes = {i: bytes([int(b_tool.id_to_piece(i)[3:-1], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in range(b_tool.get_piece_size())}

    def spans(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at += len(table[i])
        return out

    rows, count = [], collections.Counter()
    for t in texts:
        a, b, groups, links = [], [], [], []
        if t:
            a, b = spans(a_tool.encode(" " + t, add_special_tokens=False).ids, a_bytes), spans(b_tool.encode(t), b_bytes)
            if not b"".join(a_bytes[x[2]] for x in a) == (" " + t).encode() == b"".join(b_bytes[x[2]] for x in b):
                a, b = [], []
            at = 0
            for cut in sorted({x[1] for x in a} & {x[1] for x in b}):
                groups.append("|".join(",".join(str(x[2]) for x in side if at < x[1] <= cut) for side in (a, b)))
                at = cut
            links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), h) for a, b, g, x, h in rows]


EDGES = [None, "", "<|endoftext|> <s></s> <unk> <0x41>", " ", "  ", "a ", " a", "x\n y", "x \n y ", "word " * 50, "it's we'll  do n't", "a▁b", "ﬁ①Ａ", "𝔘𝔫𝔦​ ", "中文字" * 30]


def texts(seed, n=250):
    rng = random.Random(seed)
    signs = list("ab  cdeé.\n\t'sll0 12\xa0　  \x1c\x85中文字ﬁ▁")
    return ["".join(rng.choice(signs[: -1 if k % 4 else None]) for _ in range(rng.randint(0, 60))) for k in range(n)] + EDGES * 2


def check(spark, rows, **more):
    df = spark.createDataFrame([(k % 100 if k % 9 else None, t, 1, "x", 2) for k, t in enumerate(rows)], "doc_id long, text string, uid int, pack string, n_a int").repartition(3)
    got = collections.Counter(map(tuple, T.align(df, **more).collect()))
    assert got == collections.Counter((k % 100 if k % 9 else None, *r) for k, r in enumerate(plain(rows)))


def test_against_whole_texts(spark):
    check(spark, texts(1))


def test_small_packs_tiles_and_memory(spark, monkeypatch):
    for name, n in (("TILES", 3), ("PACK_LINKS", 500), ("PACK_DOCS", 7), ("SALT_POSTINGS", 200), ("REMEMBERED", 50)):
        monkeypatch.setattr(T, name, n)
    check(spark, texts(2))


def test_without_ranks(spark):
    check(spark, texts(3, 60), files=(FILES[0], None, FILES[2]))


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(1_200))
    check(spark, [long, long[:100], "z" * 1_000, long])
    assert T.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert T.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")
