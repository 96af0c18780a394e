"""Codecs with models: order-1 Huffman codes, a binary adaptive range coder, and pair grammars.

All are kernels on one block's bytes, with stored forms that decode by themselves; decoding makes as many bytes as
are asked for, or fails.
"""

from __future__ import annotations

import struct

import numpy as np

from blockwright.functions.codecs import Huffman
from blockwright.guards import FormatError, OutputLimitError, TruncatedError

# Order-1 Huffman: codes of a byte depend on the byte before it; the first byte's context is 0.


def _canonical(lengths: np.ndarray) -> list[tuple[int, str]]:
    """(symbol, code) by length, then symbol; a table of lengths says all."""
    out, code, size = [], 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - size
        size = int(lengths[s])
        if code >> size:
            raise FormatError("order-1 huffman: the lengths are of no code")
        out.append((s, format(code, f"0{size}b")))
        code += 1
    return out


def order1_encode(data: bytes) -> bytes:
    """u32 bytes, 32 bytes of contexts, for each its symbols (32 bytes) and their lengths, then the codes; big-endian."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    before = np.concatenate([[0], x[:-1]]) if len(x) else x
    counts = np.bincount(before << 8 | x, minlength=65536).reshape(256, 256)
    used = counts.any(axis=1)
    out, codes = [struct.pack(">I", len(x)), np.packbits(used).tobytes()], {}
    for c in np.flatnonzero(used).tolist():
        lengths = np.zeros(256, np.int64)
        for s, code in Huffman(counts[c]).codes.items():
            lengths[s] = len(code)
        out += [np.packbits(lengths > 0).tobytes(), lengths[lengths > 0].astype(np.uint8).tobytes()]
        codes[c] = dict(_canonical(lengths))
    bits = "".join(codes[c][s] for c, s in zip(before.tolist(), x.tolist(), strict=True))
    return b"".join(out) + np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def order1_decode(packed: bytes, bound: int) -> bytes:
    if len(packed) < 36:
        raise TruncatedError("order-1 huffman: the header ends too soon")
    n = struct.unpack(">I", packed[:4])[0]
    if n > bound:
        raise OutputLimitError(f"{n} bytes are declared; the limit is {bound}")
    at, tables = 36, {}
    for c in np.flatnonzero(np.unpackbits(np.frombuffer(packed[4:36], np.uint8))).tolist():
        symbols = np.flatnonzero(np.unpackbits(np.frombuffer(packed[at : at + 32], np.uint8)))
        given = np.frombuffer(packed[at + 32 : at + 32 + len(symbols)], np.uint8)
        at += 32 + len(symbols)
        if at > len(packed):
            raise TruncatedError("order-1 huffman: a table ends too soon")
        lengths = np.zeros(256, np.int64)
        lengths[symbols] = given
        tables[c] = {code: s for s, code in _canonical(lengths)}
    out, code, table = bytearray(), "", tables.get(0, {})
    for bit in np.unpackbits(np.frombuffer(packed[at:], np.uint8)).tolist():
        if len(out) == n:
            break
        code += "1" if bit else "0"
        s = table.get(code)
        if s is not None:
            out.append(s)
            code, table = "", tables.get(s, {})
        elif len(code) > 255:
            raise FormatError("order-1 huffman: a code is unknown")
    if len(out) < n:
        raise TruncatedError("order-1 huffman: the payload ends too soon")
    return bytes(out)


# Range coder: bits of a byte, highest first, each under the bits before it.

# 12-bit chances of a 1 bit, their limits and the rate at which they follow the bits.
_ONE, _LEAST, _MOST, _RATE = 4096, 1, 4095, 5
_TOP = (1 << 32) - 1


def adapted(chance: int, bit: int) -> int:
    """The chance of a 1 bit after a bit."""
    chance += (_ONE - chance >> _RATE) if bit else -(chance >> _RATE)
    return min(max(chance, _LEAST), _MOST)


def range_encode(data: bytes) -> bytes:
    """u32 bytes (big-endian), then the coder's bytes."""
    chances, low, high = [_ONE // 2] * 256, 0, _TOP
    out = bytearray(struct.pack(">I", len(data)))
    for byte in data:
        node = 1
        for place in range(7, -1, -1):
            bit = byte >> place & 1
            cut = low + ((high - low) >> 12) * chances[node]
            low, high = (low, cut) if bit else (cut + 1, high)
            chances[node] = adapted(chances[node], bit)
            node = node << 1 | bit
            while (low ^ high) >> 24 == 0:
                out.append(high >> 24)
                low, high = low << 8 & _TOP, (high << 8 & _TOP) | 255
    return bytes(out) + (struct.pack(">I", high) if data else b"")


def range_decode(packed: bytes, bound: int) -> bytes:
    if len(packed) < 4:
        raise TruncatedError("range coder: the header ends too soon")
    n = struct.unpack(">I", packed[:4])[0]
    if n > bound:
        raise OutputLimitError(f"{n} bytes are declared; the limit is {bound}")
    if n and len(packed) < 8:
        raise TruncatedError("range coder: the payload ends too soon")
    chances, low, high, at, out = [_ONE // 2] * 256, 0, _TOP, 8, bytearray()
    held = int.from_bytes(packed[4:8], "big")
    while len(out) < n:
        node = 1
        while node < 256:
            cut = low + ((high - low) >> 12) * chances[node]
            bit = int(held <= cut)
            low, high = (low, cut) if bit else (cut + 1, high)
            chances[node] = adapted(chances[node], bit)
            node = node << 1 | bit
            while (low ^ high) >> 24 == 0:
                if at >= len(packed):
                    raise TruncatedError("range coder: the payload ends too soon")
                low, high, held = low << 8 & _TOP, (high << 8 & _TOP) | 255, (held << 8 & _TOP) | packed[at]
                at += 1
        out.append(node & 255)
    return bytes(out)


# Grammars: the pair that comes most often becomes a symbol, round by round.


def _places(x: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """Where a pair stands, from the left, without overlaps."""
    at = np.flatnonzero((x[:-1] == pair[0]) & (x[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # in a run, every second place
        run = np.cumsum(np.append(True, np.diff(at) > 1)) - 1
        first = at[np.append(True, np.diff(at) > 1)]
        at = at[(at - first[run]) % 2 == 0]
    return at


def grammar(data: bytes, rounds: int = 1000, least: int = 2) -> tuple[list[int], list[tuple[int, int]]]:
    """(symbols, rules): rule i is symbol 256 + i. Pairs are counted where they don't overlap; of equal counts the smallest."""
    x, rules = np.frombuffer(data, np.uint8).astype(np.int64), []
    while len(rules) < rounds and len(x) > 1:
        pairs, n = np.unique(x[:-1] << 32 | x[1:], return_counts=True)
        best, most = None, least - 1
        for i in np.lexsort((pairs, -n)).tolist():
            if n[i] < max(most, least):
                break
            pair = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
            count = len(_places(x, pair)) if pair[0] == pair[1] else int(n[i])
            if count > most or (count == most and best is not None and pair < best):
                best, most = pair, count
        if best is None:
            break
        at = _places(x, best)
        x = x.copy()
        x[at] = 256 + len(rules)
        x = np.delete(x, at + 1)
        rules.append(best)
    return x.tolist(), rules


def expand(symbols: list[int], rules: list[tuple[int, int]], bound: int) -> bytes:
    """The bytes of a grammar; rules may only use older ones, and sizes are checked before any is expanded."""
    sizes = [1] * 256
    for i, (a, b) in enumerate(rules):
        if not (0 <= a < 256 + i and 0 <= b < 256 + i):
            raise FormatError(f"grammar: rule {i} uses a symbol that isn't there yet")
        sizes.append(sizes[a] + sizes[b])
    if symbols and not 0 <= min(symbols) <= max(symbols) < len(sizes):
        raise FormatError("grammar: a symbol is unknown")
    if sum(map(sizes.__getitem__, symbols)) > bound:
        raise OutputLimitError(f"grammar: over {bound} bytes")
    if sum(sizes[256:]) <= 16 * bound + 4096:  # each rule once
        words = [bytes((i,)) for i in range(256)]
        for a, b in rules:
            words.append(words[a] + words[b])
        return b"".join(map(words.__getitem__, symbols))
    out, todo = bytearray(), symbols[::-1]
    while todo:
        s = todo.pop()
        if s < 256:
            out.append(s)
        else:
            todo += rules[s - 256][::-1]
    return bytes(out)


#: name: (encode, decode with a bound), for reports and round trips.
MODELLED = {
    "grammar": (grammar, lambda packed, bound: expand(*packed, bound)),
    "order1_huffman": (order1_encode, order1_decode),
    "range": (range_encode, range_decode),
}


def grammar_pack(data: bytes) -> bytes:
    """A pair grammar as numbers of 16 bits: how many rules, their pairs, and the sequence left."""
    sequence, rules = grammar(data)
    return struct.pack(f">H{2 * len(rules) + len(sequence)}H", len(rules), *(s for pair in rules for s in pair), *sequence)


def grammar_unpack(packed: bytes, bound: int) -> bytes:
    if len(packed) < 2 or len(packed) % 2 or len(packed) < 2 + 4 * (n := struct.unpack_from(">H", packed)[0]):
        raise TruncatedError("grammar: the rules end too soon")
    numbers = struct.unpack(f">{len(packed) // 2}H", packed)[1:]
    rules = list(zip(numbers[: 2 * n : 2], numbers[1 : 2 * n : 2], strict=True))
    return expand(list(numbers[2 * n :]), rules, bound)


#: name: (bytes to bytes, and back with a bound), as backends of frames.
STORED = {"grammar": (grammar_pack, grammar_unpack), "order1_huffman": (order1_encode, order1_decode), "range": (range_encode, range_decode)}
