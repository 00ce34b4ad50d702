import hashlib
import random

import public_tokenizers
import pytest
from conftest_llm import EDGES, documents, package_on_workers  # noqa: F401
from tokenizers import Tokenizer

from rowmark.llm.bpe import ByteBPE, encode_documents, token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(PATH)


def texts():
    rng = random.Random(2)
    out = ["", "it's we'll  \t\n x", "<|endoftext|>a <|endoftext|>", "a" * 3000, "é" * 500, "\x1c\x85\xa0　 x", "12345 6é7"]
    for _ in range(400):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), 32, 0x1F600])) for _ in range(40)))
    return out


def test_same_ids_and_text_as_the_library(library, bpe):
    sample = texts()
    for text, ids in zip(sample, bpe.encode(sample), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        numbers = [int(x) for x in ids.split(",") if x]
        assert numbers == want
        import numpy as np

        assert bpe.decode(np.array(numbers, np.int64)) == library.decode(want, skip_special_tokens=False) == text


def test_forced_boundaries_never_lie_inside_a_token(bpe):
    import numpy as np

    for token in bpe.tokens[::7]:
        data = np.frombuffer(token, np.uint8)
        assert list(bpe.fragments(data, np.array([0]))) == [0]


def test_single_and_joint_merging_agree(bpe):
    for part in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaa", "Donaudampfschiff", "thethethe"):
        bpe.learn([part])
        assert bpe.parts[part] == ",".join(map(str, bpe._many([bpe.of_byte[b] for b in part.encode()])))


def test_memory_bound_changes_nothing(library):
    small = ByteBPE(PATH, remembered=3)
    sample = texts()[:60]
    got = [small.encode([t])[0] for t in sample]
    assert got == [",".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in sample]


def test_tables(documents, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(documents(EDGES), PATH).collect()}
    want = set()
    for i, text in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert token_digests(documents([]), PATH).collect() == []
    assert [list(r.ids) for r in encode_documents(documents([(1, "A b c"), (2, None)]), PATH).orderBy("doc_id").collect()] == [
        library.encode("A b c").ids, []
    ]
