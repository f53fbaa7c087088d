"""op7, op9, op10: the tokenizers library and exact round trips."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import jpeg
from lexiforge.llm.bpe import Merges
from lexiforge.llm.bpe_codec import Codec, coded_column, tokenizer_path
from lexiforge.llm.media import media_column, read_back
from lexiforge.llm.token_counts import Counter, count_column

ODD = [
    "", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ς", "ﬁ ² ½ Ⅷ é", "日本語 テキスト 한국어", "a" * 5000, "ab" * 3000 + "ing",
    "\x1c\x1d a\x85b\xa0c d", "it's WE'LL 'S don't", "😀👍🏽", "123 45٣٤", "x<|endoftext|", "\n\n  \t a  ", "Ꟶ \U00010d50", "'" * 700, "İ" * 300,
]


def fuzz(n=150):
    rng = random.Random(2)
    letters = "abcdefgh tinhoe'\n.,éß中ア１Σ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(n)]
    return out + ["".join(rng.choice("thenaio") for _ in range(rng.randint(300, 3000))) for _ in range(30)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return ODD + fuzz() + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_codec(texts):
    own, theirs = Codec(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        raw, shown = own.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids, t[:60]
        assert shown == theirs.decode(ids, skip_special_tokens=False), t[:60]


@pytest.mark.parametrize("leaf", [2, 16, 64])
def test_tree_concatenation(leaf):
    whole, tree = Merges(tokenizer_path("word_bpe_49k.json"), 10**9), Merges(tokenizer_path("word_bpe_49k.json"), leaf)
    for t in [x for x in fuzz(40) if x] + ["a" * 999, "ha" * 777]:
        symbols = whole.symbols(t.replace(" ", "").encode())
        assert tree.encode(symbols) == whole.merge(symbols)
    assert tree.ordered
    tree.ordered = False
    assert tree.encode(symbols) == whole.merge(symbols)


def test_counts(texts):
    own, theirs = Counter(tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for t in texts:
        assert own.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), t[:60]


def test_whole_tokens_are_proven():
    own, theirs = Counter(tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for t in random.Random(1).sample(sorted(own.whole), 500):
        assert len(theirs.model.tokenize(t.encode().decode("latin-1").translate({i: c for i, c in enumerate(__import__("lexiforge.llm.bpe", fromlist=["x"]).byte_alphabet())}))) == 1


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "hello there"), (3, "hello there")], "n_tokens long, text string")
    got = df.select(coded_column(F.col("text")).alias("c"), count_column(F.col("text")).alias("k"), media_column(F.col("text")).alias("m")).collect()
    assert [r.c.n_tokens for r in got] == [0, 0, 2, 2] and [r.k for r in got] == [0, 0, 2, 2]
    assert got[0].c.decoded == "" and got[2].c.decoded == "hello</w> there</w>"
    assert got[0].m == got[1].m and got[2].m == got[3].m and got[0].m.payload_bytes == 576 and got[0].m.n_bytes == 0
    assert df.limit(0).select(coded_column(F.col("text")), media_column(F.col("text"))).count() == 0


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    raw = [b"", b"a", bytes(range(256)) * 9, b"x" * 575, b"x" * 576, b"y" * 577, rng.integers(0, 256, 450_000, dtype=np.uint8).tobytes(), b"\x00\xff" * 5000]
    assert jpeg.shape_of(576) == (24, 24) and jpeg.shape_of(24 * 8191) == (24, 8191) and jpeg.shape_of(jpeg.BLOCKS)[0] < 8192
    padded = [jpeg.pad(r) for r in raw]
    files = jpeg.encode_many(padded)
    back = read_back(files)
    assert [b for b, _ in back] == padded
    assert [f for _, f in back] == [read_back([f])[0][1] for f in files]
    assert back[6][1].startswith("576x") and files[6].count(b"\xff\xd8\xff\xfe") == 1
    assert files[0][:2] == b"\xff\xd8" and files[0][-2:] == b"\xff\xd9"


def test_general_baseline_jpeg():
    """Blocks with AC coefficients, no restart markers, three components at 2x1 sampling."""
    dc = {0: (0b00, 2), 3: (0b01, 2), 4: (0b10, 2)}
    ac = {0x00: (0b0, 1), 0x02: (0b10, 2), 0xF0: (0b110, 3)}
    body = lambda t: bytes(sum(1 for _, n in t.values() if n == k) for k in range(1, 17)) + bytes(sorted(t, key=lambda s: t[s][1]))
    bits = ""

    def put(code, n):
        nonlocal bits
        bits += format(code, f"0{n}b")

    def block(diff, acs):
        n = abs(diff).bit_length()
        put(*dc[n])
        if n:
            put(diff if diff > 0 else diff + (1 << n) - 1, n)
        if acs:
            put(*ac[0xF0])
            put(*ac[0x02])
            put(0b11, 2)
        put(*ac[0x00])

    for mcu in range(2):
        block(7, True), block(-5, False), block(0, True), block(4, False)  # two luminance blocks, then Cb and Cr
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    file = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 32, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, b"\x00" + body(dc)) + seg(0xC4, b"\x10" + body(ac)) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    plane = jpeg.luminance(jpeg.parse(file))[0]
    assert plane.tolist() == [[128 + 14, 128 + 4, 128 + 18, 128 + 8]]
    with pytest.raises(ValueError):
        jpeg.parse(file.replace(b"\xff\xc0", b"\xff\xc2"))


def test_media_query(spark, sf):
    from lexiforge.llm.queries import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries()["op10_media_columns"](spark, sf).collect():
        payload = jpeg.pad(docs[r.doc_id].encode())
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload))
