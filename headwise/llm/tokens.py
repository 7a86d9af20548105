"""Token ids by the tokenizers library, for operators that only need the ids.

The library encodes each distinct piece of a batch (see ``pieces``), many pieces in one text, which falls apart again
where a token begins with a blank. Edge cases are those of ``pieces``.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from headwise.llm.common import sole_memory
from headwise.llm.pieces import Pieces

#: Pieces that go to the library as one text.
RUN = 400


class LibraryTokens(Pieces):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.model._resize_cache(0)  # it only gets distinct pieces
        vocabulary = self.library.get_vocab()
        self.after_blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.after_blank[[i for token, i in vocabulary.items() if token[:1] == "Ġ"]] = True  # the letter of the byte 0x20
        super().__init__([t.content for t in self.library.get_added_tokens_decoder().values()])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        runs = [pieces[i : i + RUN] for i in range(0, len(pieces), RUN)]
        for run, data in zip(runs, self._whole([" " + " ".join(run) for run in runs]), strict=True):
            starts = (np.nonzero(self.after_blank[np.frombuffer(data, "<u4")])[0] * 4).tolist()
            if len(starts) == len(run):
                out += [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
            else:
                out += self._whole([" " + x for x in run])
        return out


@lru_cache(maxsize=1)
def _library_tokens(path: str) -> LibraryTokens:
    return LibraryTokens(path)


def library_tokens(path: str) -> LibraryTokens:
    """The worker's encoder of a vocabulary."""
    sole_memory("library tokens", _library_tokens.cache_clear)
    return _library_tokens(path)
