"""The tokenizers' memory of chunks."""

import random

import pytest

from tessera.llm import tokens
from tessera.llm.tokens import ChunkEncoder, tokenizer_path


@pytest.mark.parametrize(("kind", "name"), [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_what_is_remembered_is_not_gone_through(kind, name):
    class Memory(dict):
        def __iter__(self):
            raise AssertionError("goes through all that is remembered")

        keys = items = values = __iter__

    e = ChunkEncoder(tokenizer_path(name), kind)
    e.young = Memory()
    texts = ["it's one text, and he'll say 'twas 42", "don't 's 'tis o'clock rock'n'roll's", "déjà-vu 3½ it's"]
    for _ in range(2):
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [e.numbers(x).tolist() for x in e.encode(texts)] == want


def test_a_repeated_word_is_looked_up_once():
    class Memory(dict):
        looks = 0

        def __getitem__(self, key):
            self.looks += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.looks += 1
            return super().get(key, default)

    e = ChunkEncoder(tokenizer_path("word_bpe_49k.json"), "word")
    e.young = Memory()
    texts = ["The cat's 2 naps,\n\tthe CAT! " * 5_000, "Déjà vu. " * 5_000]
    for _ in range(2):
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [e.numbers(x).tolist() for x in e.encode(texts)] == want
    assert e.young.looks < 100


def test_words_are_cut_as_the_pattern_cuts_them():
    rng = random.Random(7)
    letters = [c for c in map(chr, range(256)) if c.encode("latin-1") not in tokens.RARE_BYTES]
    texts = ["".join(letters), "'", "'s", "it's'll've're'd'm't", "!'s ''s 4's s's'", "l'lla'l le'r r'e d'v'e", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for alphabet in (letters, "'srevl d", "'tm2²½!. \n") for _ in range(2_000))]
    for t in texts:
        data = t.encode("latin-1").translate(tokens.LOWER)
        at = tokens.word_cuts(data + b"\n\n")
        got = [(data + b"\n\n")[a:b].decode("latin-1") for a, b in zip(at, at[1:])]
        assert [c for c in got if not c.isspace()] == tokens.LATIN_WORD.findall(t.lower()) and "".join(got) == t.lower() + "\n\n"
    e = ChunkEncoder(tokenizer_path("word_bpe_49k.json"), "word", generation=300)
    for group in (texts, [None, "", "Ω", "\xa0", " ", *texts[::-1], "a<|endoftext|>b", "é", None], [None, ""], [" \n", "\t"]):
        assert [e.numbers(x).tolist() for x in e.encode(group)] == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in group], add_special_tokens=False)]
