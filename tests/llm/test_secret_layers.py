"""Secrets in layers that are nested, concatenated, no clean text, large, split or in need of their context."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard

from marketgrid.llm import secrets

SECRET = b"password=hunter2hunter2"
PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


def b64(raw):
    return base64.b64encode(raw).decode()


def found(text, **options):
    """Texts of the assignments that stand in layers."""
    base, every, _, _ = secrets.spans(text.encode(), **options)
    return sorted({text[a:b] for k, a, b in set(every) - set(base) if k == "assign"}, key=len)


@pytest.mark.parametrize("outer", PACKERS)
def test_compressed_in_compressed_and_later_members_open(outer):
    pack = PACKERS[outer]
    for inner in PACKERS.values():
        blob = b64(pack(inner(SECRET)))
        assert found(f"see {blob} end")[-1] == blob
    blob = b64(pack(b"first part ") + pack(b"then pass") + pack(SECRET[4:]))
    assert found(f"see {blob} end")[-1] == blob


def test_bytes_that_are_no_clean_text_are_scanned():
    for raw in (b"\x00\x01\xff" + SECRET + b"\xfe\x07", "naïve ".encode("latin-1") + SECRET, SECRET.decode().encode("utf-16"), SECRET.decode().encode("utf-16-be"), SECRET.decode().encode("utf-32"), b"\x89PNG" + gzip.compress(b"\xff" + SECRET) + b"tail"):
        part = found(f"see {b64(raw)} end")[-1]
        assert part in b64(raw)
    # noise is no layer, and finds nothing
    noise = random.Random(1).randbytes(300)
    assert secrets.spans(b64(noise).encode()) == ([], [], 0, False)


def test_large_layers_open_in_parts():
    for pack in PACKERS.values():
        for at in (0, 99_990, 350_000):
            blob = b64(pack(b" " * at + SECRET + b" " * (400_000 - at)))
            assert found(blob, limit=100_000)[-1] == blob
            assert secrets.spans(blob.encode(), limit=100_000)[3]
    cut = gzip.compress(SECRET + random.Random(2).randbytes(5000))[:3000]
    assert found(b64(cut))


def test_encoded_values_keep_their_keywords():
    for text, want in (
        ("set api_key = abc%2Bdefgh123456 now", "api_key = abc%2Bdefgh123456"), ('a password: "\\u0068unter2hunter2" b', 'password: "\\u0068unter2hunter2'), ("token : abc&#100;efghij", "token : abc&#100;efghij"),
        ("é%20é token: %61bcdefghijk", "token: %61bcdefghijk"), ("password: token:%61bcdefghij", "token:%61bcdefghij"), ("%70assword%20= abcdefghij", "%70assword%20= abcdefghij"),
    ):
        assert found(text)[-1] == want, text


def test_wrapped_and_glued_base64():
    r = random.Random(3)
    filler = bytes(r.choice(b"abcdefgh \n") for _ in range(500))
    for raw in (filler[:50] + SECRET + filler, gzip.compress(filler + SECRET + r.randbytes(300))):
        whole = b64(raw)
        for gap in ("\n", "\r\n", "\n    "):
            wrapped = gap.join(whole[i : i + 76] for i in range(0, len(whole), 76))
            shown = found(f"-----BEGIN-----\n{wrapped}\n-----END-----")[-1]
            assert shown in wrapped and ("\n" in shown)
    for glue in ("cb/", "a-", "xy_", "file", "/"):
        for raw in (SECRET, gzip.compress(SECRET)):
            text = f"see {glue}{b64(raw)} end"
            assert b64(raw) in found(text)[-1], glue


def test_percent_signs_in_a_stream_are_no_layer():
    r = random.Random(5)
    raw = b"%41%42%43 " + r.randbytes(2000) + b"%70assword=abcdefghij%31 and more" + r.randbytes(2000)
    assert found(b64(raw))[0] in b64(raw)  # a long readable stretch is decoded, alone
    words = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(10**9)) for _ in range(60000)).encode()
    base, every, layers, over = secrets.spans(b64(gzip.compress(words)).encode())
    assert (base, every, over) == ([], [], False) and layers == 1  # the words; nothing by chance


def test_shifts_stop_at_the_one_that_makes_sense():
    opened = []
    plain = secrets._run_layers

    def counted(*args):
        for layer in plain(*args):
            opened.append(1)
            yield layer

    secrets._run_layers = counted
    try:
        secrets.spans(f"see {b64(b'just some readable text here')} end".encode())
        secrets.spans(f"see {b64(gzip.compress(random.Random(1).randbytes(500)))} end".encode())
    finally:
        secrets._run_layers = plain
    assert len(opened) == 2


_MEASURE = """
import base64, gzip, random, resource, sys, time
sys.path.insert(0, {root!r})
from marketgrid.llm import secrets
r = random.Random(1)
words = [("".join(r.choice("abcdefghijklmnop") for _ in range(3 + i % 7))).encode() for i in range(3000)]
part = b" ".join(r.choice(words) for _ in range(200_000))
whole = b"".join(part[k * 7 % 1000 :] + b" %d " % k for k in range({mb} * 1_000_000 // len(part) + 1))[: {mb} * 1_000_000]
text = base64.b64encode(gzip.compress(whole[:-30] + b" password=hunter2hunter2 ", 1))
del whole, part
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
start = time.process_time()
base, every, layers, over = secrets.spans(text)
assert ("assign", 0, len(text)) in every and not over, every
print(len(text), time.process_time() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, before / 1024)
"""


def measured(mb):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", _MEASURE.format(root=root, mb=mb)], capture_output=True, text=True, timeout=300, check=True)
    return [float(x) for x in got.stdout.split()]


def test_one_large_nested_text_stays_within_bounds():
    small, large = measured(12), measured(50)
    assert large[2] < 500, large  # MB at the peak, text and all
    assert large[1] / large[0] < 3 * small[1] / small[0] + 1e-6, (small, large)  # seconds a byte don't grow
