"""Alignment against whole texts encoded by both libraries and a plain count of pairs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sigloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, block bigint, A string, data int"
ODD = ["plain words, and more words.", "  two  spaces\t tab \n\n lines \n x  ", " ", "   ", "\n", "größe naïve Ελληνικά русский 中文字 日本 \U0001f600\U0001f468‍\U0001f469", "nbsp here 　wide  em sep \u0085nel x", "<|endoftext|> </s> <s> <unk> <0x41>", "a▁b is lost", "don't I'll we've 12,345.67 http://x.y/z?q=1", "\x00 control \x1f \x7f bytes \x1c y", "word " * 3_000 + "end", "x" * 5_000, "é ﬁ ① Å", "trailing space ", "tab\t", "é  ü   ß    x", "à b ß c ​ d"]


def whole(a, b, alphabet, text):
    """Token ids and bytes of both sides of one whole text, without any cut."""
    if not text:
        return None
    wanted = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    return (x, xs, y, ys) if b"".join(xs) == wanted == b"".join(ys) else None


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    made, count = [], Counter()
    for text in texts:
        got = whole(a, b, alphabet, text)
        if got is None:
            made.append(None)
            continue
        x, xs, y, ys = got
        sx, sy = spans(xs), spans(ys)
        links, j0 = [], 0
        for i, (p, q) in enumerate(sx):
            while sy[j0][1] <= p:
                j0 += 1
            j = j0
            while j < len(sy) and sy[j][0] < q:
                links.append((x[i], y[j]))
                j += 1
        both = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = [[[], []] for _ in both]
        for side, (ids, ends) in enumerate(((x, sx), (y, sy))):
            k = 0
            for i, (_, e) in zip(ids, ends):
                while both[k] < e:
                    k += 1
                groups[k][side].append(str(i))
        made.append((len(x), len(y), len(both), links, ";".join("|".join(",".join(s) for s in g) for g in groups)))
        count.update(set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(count[p] == best[p[0]] for p in m[3]), sum(count[p] for p in m[3]), hashlib.sha256(m[4].encode()).hexdigest()) for m in made]


def shown(rows):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=repr)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute([t for _, t in docs]))), key=repr)
    assert shown(queries.op11_alignment(spark, sf).collect()) == want


@pytest.mark.parametrize("options", [{}, {"block_docs": 3}, {"block_bytes": 1}])
def test_odd_texts(spark, options):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "plain words, and more words."), (0, "plain words, and more words."), (90, None), (91, "")] + [(100 + k, f"copy of the words {k % 3}") for k in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    got = shown(alignment.align(docs, A, B, **options).collect())
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=repr)
    zeros = {r[0] for r in got if r[1:] == (0, 0, 0, 0, 0, 0, "")}
    assert {8, 90, 91} <= zeros


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.align(docs, A, B).collect() == []
    assert alignment.align(spark.createDataFrame([(1, None, 0, "", 0)], SCHEMA), A, B).collect()[0].n_a == 0


def test_pair_counts(spark):
    docs = spark.createDataFrame([(k, "same words same words", 0, "", 0) for k in range(9)], SCHEMA).repartition(4)
    counts = alignment.pair_counts(alignment.write_postings(docs, A, B)).collect()
    assert {r.docs for r in counts} == {9} and len(counts) == len({(r.a, r.b) for r in counts})


def test_overlaps():
    shown = lambda *sides: [x.tolist() for x in alignment.overlaps(*map(np.array, sides))]
    assert shown([2, 5, 6], [3, 6]) == [[0, 1, 1, 2], [0, 0, 1, 1], [2], [1]]
    assert shown([1, 3], [1, 2, 3]) == [[0, 1, 1], [0, 1, 2], [0, 1], [0, 2]]
