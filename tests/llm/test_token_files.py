import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from hatospark.llm import token_files
from hatospark.llm.token_files import Encoder, read_tokens, span, token_files as digests, with_start, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def test_every_text_equals_the_library(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    monkeypatch.setattr(token_files, "KNOWN_CHUNKS", 300)
    rng = random.Random(3)
    letters = "aabcdehilmnorstuv' '   \n\n\t\r!.,#0123éßñ日本Ω\xa0\x85\x1c\u2003\u3000\u200b😀'll's"
    plain = "aabcdehilmnorstuv' '   \n\n\t\r!.,;?#0123éßñ日本Ω😀'll's"
    for k in range(60):
        texts = []
        for _ in range(60):
            text = "".join(rng.choice(letters if k % 2 else plain) for _ in range(rng.randint(0, 60)))
            texts.append(text + rng.choice(["", "", "", "<|endoftext|>" * (k % 2) + text[:5], "  ", "\n \n", "\x01"]))
        values, counts = encoder.encode(pa.array(texts))
        got = [v.tolist() for v in np.split(values, np.cumsum(counts)[:-1])]
        assert got == [ids_of(library, t)[:-1] for t in texts]


def test_vocabularies_of_other_kinds():
    for name in ("word_bpe_49k.json",):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            encoder = Encoder(f.read())
        other = Tokenizer.from_file(path)
        assert not encoder.by_chunk
        text = "The quick  brown fox,\n it's"
        assert encoder.encode(pa.array([text]))[0].tolist() == other.encode(text, add_special_tokens=False).ids


def test_round_trip(odd_documents, no_documents, library):
    rows = digests(odd_documents, PATH).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted(
        (r.doc_id is not None, r.doc_id or 0) for r in odd_documents.collect()
    )
    want = sorted(
        (r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for r in odd_documents.collect()
        for ids in [ids_of(library, r.text)]
    )
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id is not None and r.doc_id or -1 for r in rows]
    assert ids == sorted(ids)
    assert digests(no_documents, PATH).count() == 0


def test_selective_reads(spark, rows, library, tmp_path):
    rng = random.Random(5)
    data = [(i * 7, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.\n"]) for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    folder = str(tmp_path / "tokens")
    write_tokens(rows("doc_id long, text string", data).repartition(3), PATH, folder, page_rows=50)
    stream = [i for _, text in data for i in ids_of(library, text)]
    for start, length in ((0, 10), (len(stream) // 2, 700), (len(stream) - 5, 50), (7, 0)):
        got = sorted(span(spark, folder, start, length).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == stream[start : start + length]
    one = with_start(read_tokens(spark, folder).filter("doc_id = 700"), folder).first()
    assert one.ids == stream[one.start : one.start + one.n_tokens]
    plan = read_tokens(spark, folder).filter("doc_id = 700").select("n_tokens")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,700)" in plan and "ids" not in plan


def test_files_hold_indexes_pages_and_encodings(rows, tmp_path):
    rng = random.Random(6)
    data = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(100))) for i in range(4000)]
    folder = str(tmp_path / "tokens")
    write_tokens(rows("doc_id long, text string", data).coalesce(1), PATH, folder, row_group=100_000)
    groups = 0
    for name in glob.glob(folder + "/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema: c for c in map(meta.row_group(g).column, range(5))}
            groups += 1
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            for c in ("doc_id", "before", "n_tokens"):
                assert columns[c].encodings == ("DELTA_BINARY_PACKED",)
    assert groups > len(glob.glob(folder + "/*.parquet"))
