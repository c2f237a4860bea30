"""A model's character map, compiled: which runs of characters the normaliser rewrites, and to what.

The file holds a double-array trie over UTF-8 bytes and a table of results.  Compilation walks all of
the trie's paths once and keeps the rules as a transducer over characters: at each place the longest
source that begins there is replaced, any other character passes.  Texts without a character that a
rule ends with are left alone, and where only single characters are rewritten, one table look-up
does it.
"""

from __future__ import annotations

import re
import struct

import numpy as np


def read_rules(blob: bytes) -> dict[str, str]:
    """Source and result of every rule of a compiled map."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, results = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    rules: dict[str, str] = {}
    work = [(offset(units[0]), b"")]
    while work:
        place, path = work.pop()
        for byte in range(1, 256):
            at = place ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            below = at ^ offset(units[at])
            if units[at] >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                rules[(path + bytes([byte])).decode()] = results[start : results.index(b"\0", start)].decode()
            work.append((below, path + bytes([byte])))
    return rules


class CharacterMap:
    def __init__(self, blob: bytes):
        self.rules = read_rules(blob)
        self.single = {ord(k): v for k, v in self.rules.items() if len(k) == 1}
        self.trie: dict = {}
        for source, result in self.rules.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = result
        ends = {k[-1] for k in self.rules}
        pattern = lambda chars: re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]") if chars else None
        self.any, self.joint = pattern(ends), pattern({k[-1] for k in self.rules if len(k) > 1})

    def touches(self, text: str) -> bool:
        return self.any is not None and self.any.search(text) is not None

    def __call__(self, text: str) -> str:
        if not self.touches(text):
            return text
        if self.joint is None or self.joint.search(text) is None:
            return text.translate(self.single)
        out, i = [], 0
        while i < len(text):
            node, best, end = self.trie, text[i], i + 1
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], j + 1
            out.append(best)
            i = end
        return "".join(out)
