"""Parts of texts are told apart before they are looked up; ids stay the library's."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm.token_store import Numbered, PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_part_is_looked_up_once_a_block():
    class Counted(Numbered):
        asked = 0

        def __getitem__(self, part):
            Counted.asked += 1
            return super().__getitem__(part)

    enc = PieceEncoder(PATH)
    enc.known = Counted(enc.dtype)
    enc.encode(["first " + " ".join(["one", "two,", "three"] * 500)] * 20)
    assert Counted.asked == 3


def test_ids_of_every_kind_of_text():
    enc, tok = PieceEncoder(PATH), Tokenizer.from_file(PATH)
    added = [t.content for t in tok.get_added_tokens_decoder().values()][:1]
    kinds = ["", "a", "one two", " led", "end ", "two  blanks", "Ünï cödé, 漢字 x　y",
             "line\nnext line", "tab\there it", "don't we'll 12,345.67 (a) b", *added,
             *(f"with {a} inside" for a in added), "\U0001F600 x \U0001F600"]
    for texts in (kinds, kinds[::-1], [""], [" x"], ["two  blanks"] * 3, []):
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()
                for t in texts]
        assert enc.encode(texts) == want
        assert enc.encode(texts) == want  # as remembered
