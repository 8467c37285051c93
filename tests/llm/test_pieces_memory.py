"""What a worker of the encoding holds for each part that it remembers."""

import tracemalloc

import public_tokenizers

from sessile.llm import pieces


def test_remembered_parts_are_small():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.MergeModel(f.read())
    texts = [" ".join(f"{chr(97 + i // 17576 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(at, at + 2_000)) for at in range(0, 40_000, 2_000)]
    tracemalloc.start()
    try:
        for text in texts:
            model.encode([text])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    n = len(model.recent)
    assert n == 40_000 and held / n < 220, held / n


def test_parts_that_decode_to_another_text_keep_it(monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.MergeModel(f.read())
    i = model.ids["▁the"]
    model.surface[i] = b" THE"
    assert model.encode(["the end, the end", "end"])[1] == [b"THE end, THE end", b"end"]
