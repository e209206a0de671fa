from pitchside.llm.tokens import PLAIN, encoder
from pitchside.llm.vocabulary import default_vocabulary


def test_fast_path_gives_the_tokenizers_ids_for_every_character_it_takes():
    enc = encoder(default_vocabulary())
    taken = [c for c in map(chr, range(0x110000)) if PLAIN.fullmatch(c) and not c.isspace()]
    assert len(taken) > 400
    for c in [*taken, *"ƏƆƐƁƊƔƷ"]:
        for text in (c, c + c, f"A{c}B", f"{c}liyev", f"-{c}1"):
            assert enc.chunk(text) == enc._whole(text), text
