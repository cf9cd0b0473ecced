"""Two tokenizers aligned, against encoding whole texts and comparing all overlaps."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from causeway.llm import alignment, queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isfile(alignment.BYTE_BPE), reason="no vocabularies")


def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    known = alignment.Aligner(a.to_str(), open(alignment.PIECE_BPE, "rb").read(), 10)
    return a, b, known.bytes_a, known.bytes_b


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a, b, bytes_a, bytes_b = vocabularies()
    links, out = [], []
    for text in texts:
        links.append(Counter())
        out.append((0, 0, 0, 0, ""))
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(bytes_a[i] for i in x) == b"".join(bytes_b[i] for i in y) == (" " + text).encode():
            continue
        spans, ends = [], []
        for ids, known in ((x, bytes_a), (y, bytes_b)):
            at = [0]
            for i in ids:
                at.append(at[-1] + len(known[i]))
            spans.append(list(zip(ids, at, at[1:])))
            ends.append(set(at[1:]))
        j = 0
        for i, s, e in spans[0]:
            while j and spans[1][j][1] > s:
                j -= 1
            while j < len(y) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    links[-1][i, spans[1][j][0]] += 1
                j += 1
            j = min(j, len(y) - 1)
        groups, last = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i, s, e in side if last < e <= end) for side in spans) if len(text) < 3000 else None)
            last = end
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(text) < 3000 else None
        out[-1] = (len(x), len(y), len(groups), sum(links[-1].values()), sha)
    held = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    full = []
    for (n_a, n_b, n_groups, n_links, sha), own in zip(out, links, strict=True):
        full.append((n_a, n_b, n_groups, n_links, sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), sha))
    return full


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


ODD = [
    None, "", " ", "  two  spaces ", "a  b  c", "tab\t x\n\n  y \r\n z", "▁ literal ▁mark", "<s> </s> <|endoftext|> <unk> <0x41>", "ﬁ ligature ½ Å é é", "日本語 のテキスト　全角", "🙂 👩‍👩‍👧 emoji",
    "a" * 1500, "x\x00y \x01", "it's we'll DON'T 12 345 6,7", "   em 　 wide", "﻿bom", "newline\nat end\n", "Ελληνικά и русский", "the the the the", "the the the the",
    "\u0085 next", "e  x", "‍ joiner ‌ non",
]


@pytest.mark.parametrize("block,parts", [(alignment.BLOCK_BYTES, alignment.PARTS), (64, 5)])
def test_odd_texts(spark, block, parts):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100 + i, f"{t} the end {i % 3}", "y") for i, t in enumerate(ODD) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_best string")  # an extra column called like a result
    assert got(alignment.align(docs.repartition(3), block_bytes=block, parts=parts)) == {r[0]: w for r, w in zip(rows, brute([r[1] for r in rows]), strict=True)}


def test_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "the end"), (1, "the end"), (1, "the end"), (1, "an end")], "doc_id int, text string")
    out = alignment.align(docs).collect()
    assert sorted((r.doc_id or 0, r.count_sum > 0) for r in out) == [(0, True), (1, True), (1, True), (1, True)]
    assert len({(r.count_sum, r.groups_sha256) for r in out}) == 2
    assert alignment.align(docs.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]), strict=True)}
    have = got(queries.op13_tokenizer_alignment(spark, DATA))
    assert have.keys() == want.keys() and all(have[i][:-1] == w[:-1] and (w[-1] is None or have[i][-1] == w[-1]) for i, w in want.items())
