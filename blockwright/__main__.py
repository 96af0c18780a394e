"""``python -m blockwright compress|decompress|report IN [OUT]``, ``python -m blockwright doctor``."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext
from importlib.metadata import PackageNotFoundError, version

from blockwright.functions import codecs, kernels
from blockwright.guards import BlockError
from blockwright.sources import container


def doctor() -> int:
    """Versions of what is used, and whether every backend and transform gives a sample back; 1 if not."""
    bad = 0
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "zstandard"):
        try:
            print(f"{name}\t{version(name)}")
        except PackageNotFoundError:
            print(f"{name}\tmissing")
            bad = 1
    sample = bytes(range(256)) * 8 + b"the same line\n" * 50
    for backend in codecs.BACKENDS:
        good = container.decompress(container.compress(sample, 1, 1024, backend)) == sample
        print(f"backend {backend}\t{'ok' if good else 'fails'}")
        bad |= not good
    for t in kernels.REGISTRY.values():
        got = t.encode(sample, kernels.Memo(sample))
        good = got is not None and t.decode(*got) == sample
        print(f"transform {t.tid} {t.name}\t{'ok' if good else 'fails'}")
        bad |= not good
    return int(bad)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="blockwright")
    p.add_argument("command", choices=["compress", "decompress", "report", "doctor"])
    p.add_argument("source", nargs="?", default="-", help="a file, or - for standard input")
    p.add_argument("target", nargs="?", default="-", help="a file, or - for standard output")
    p.add_argument("--backend", default="zstd")
    p.add_argument("--level", type=int)
    p.add_argument("--block-size", type=int, default=65536)
    p.add_argument("--fast", action="store_true")
    p.add_argument("--dictionary", action="store_true", help="train one on the first million bytes (zstd)")
    p.add_argument("--max-output", type=int)
    a = p.parse_args(argv)
    if a.command == "doctor":
        return doctor()
    source = nullcontext(sys.stdin.buffer) if a.source == "-" else open(a.source, "rb")
    try:
        with source as r:
            if a.command == "report":
                for i, (h, f) in enumerate(container.frames(r, a.max_output)):
                    print(f"{i}\tversion {h.version}\t{h.backend}\ttransform {f.tid}\t{f.orig_len}\t{len(f.payload)}")
                return 0
            with nullcontext(sys.stdout.buffer) if a.target == "-" else open(a.target, "wb") as w:
                if a.command == "compress":
                    container.compress_stream(r, w, a.block_size, a.backend, a.level, a.fast, a.dictionary)
                else:
                    container.decompress_stream(r, w, a.max_output)
    except (BlockError, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
