"""Layers that unfold to very much text, and runs without a place to cut."""

import base64
import gzip
import random
import tracemalloc
import zlib

import pytest

from rackmeter.llm import secrets

SECRET = b"password=Abcdefgh12345678"
KEY = b"AKIA" + b"B" * 16


def packed(data):
    return base64.b64encode(gzip.compress(data, 6)).decode()


def kinds(text):
    base, found = secrets.scan(text)
    assert not base
    return {kind for kind, *_ in found}


@pytest.mark.parametrize("place", [0, 1, 2_000_000, 5_100_003])
def test_secrets_in_a_run_without_cuts(place):
    run = bytearray(b"z" * 6_000_000)
    run[place : place + len(SECRET)] = SECRET
    run[place + 700_001 : place + 700_001 + len(KEY)] = KEY
    assert kinds(f"see {packed(bytes(run))} end") == {"assign", "access"}


def test_blanks_between_name_and_value():
    assert kinds(f"x {packed(b'token' + b' ' * 5_000_000 + b'= Abcdefgh12345678')} y") == {"assign"}


@pytest.mark.parametrize("width", [76, 0])
def test_compressed_data_in_a_long_run_inside_of_a_layer(width):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(1_900_000))
    inner = base64.b64encode(gzip.compress(noise.hex().upper().replace("A", "G").encode() + b"\n" + SECRET + b"\n", 1))
    if width:
        inner = b"\n".join(inner[i : i + width] for i in range(0, len(inner), width))
    assert len(inner) > secrets.LONG
    text = "see " + packed(b"log: " + inner + b" end of log") + " end"
    assert "assign" in kinds(text)


def test_plain_base64_in_a_long_run_inside_of_a_layer():
    inner = base64.b64encode(b"Q" * 3_500_000 + SECRET + b"Q" * 900_000)
    assert kinds("see " + packed(b"log: " + inner + b" end") + " end") >= {"assign"}


def test_memory_does_not_grow_with_what_a_run_unfolds_to():
    peaks = []
    for size in (20, 80):
        folded = zlib.compressobj(9, zlib.DEFLATED, zlib.MAX_WBITS | 16)
        parts = [folded.compress(b"z" * (1 << 20)) for _ in range(size)]
        text = "see " + base64.b64encode(b"".join([*parts, folded.flush()])).decode() + " end"
        tracemalloc.start()
        assert secrets.scan(text) == ([], [])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + (1 << 20) and peaks[1] < 100 << 20
