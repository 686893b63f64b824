import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm.packing import ChunkEncoder, default_files, pack_documents

ODD = ["", " ", "a  b", "a \nb", " x", "x ", "\n\nq", "a\n\n\nb", "it's 'll don't.", "naïve œuvre 日本語 ½ x²", "<|endoftext|> hi", "<|endoftext|>", "a<|endoftext|>b", "one two<|endoftext|><|endoftext|> three.\nfour <|endoftext|>", "<|endoftext", "|endoftext|>", "a\tb \t c",
       "x\xa0y", "a \xa0b", "a\x1cb", "\r\na", "tail \n", "no'.", "word%%% or|", "éé, ß.", "x  \n  y", "​ a", "A.B. c"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_files()[0])
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def test_chunks_have_the_library_ids(library):
    encoder = ChunkEncoder(*default_files())
    for text in ODD:
        assert encoder.encode(text) == library(text).tobytes(), text
    assert library("<|endoftext|>").tolist() == [50256]


def check(rows, docs, library, size=1024):
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(np.append(library(text or ""), np.uint32(0)).astype("<u4"))
    windows, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        seen[r.doc_id].append(r)
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
        assert sum(p.length for p in pieces) <= size
    assert set(seen) == set(texts)
    for doc_id, pieces in seen.items():
        ids, copies = texts[doc_id][0], len(texts[doc_id])
        assert sum(p.length for p in pieces) == copies * len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
        covered = np.zeros(len(ids), int)
        for p in pieces:
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies).all()
    held = np.array([sum(p.length for p in pieces) for pieces in windows.values()])
    padded = np.where(held & (held - 1) == 0, held, size)
    return 1 - held.sum() / padded.sum()


def test_every_id_lies_in_one_piece(docs, library):
    rows = pack_documents(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], library)


def test_little_padding_over_many_partitions(spark, library):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["lorem"] * int(n))) for i, n in enumerate(rng.integers(0, 900, 600))]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    assert check(pack_documents(df).collect(), data, library) < 0.03


def test_empty_table(no_docs):
    assert pack_documents(no_docs).collect() == []
