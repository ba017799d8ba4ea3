"""Secret scans against plain patterns, and structures that confirm candidates."""

import base64
import json
import random
import re

from doctriage.llm import secrets


def _der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 + len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + content


def _rsa_key(rng):
    numbers = [_der(2, b"\0")] + [_der(2, bytes([1 + rng.randrange(120)]) + rng.randbytes(n)) for n in (127, 2, 127, 63, 63, 63, 63, 63)]
    return _der(0x30, b"".join(numbers))


def _url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _signed():
    head, body = ({"alg": "HS256", "typ": "JWT"}, {"sub": "someone", "n": 5})
    return f"{_url64(json.dumps(head).encode())}.{_url64(json.dumps(body).encode())}.{_url64(bytes(range(32)))}"


def _brute(text):
    """Base spans by patterns without lengths, failing matches dropped afterwards."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return {
        "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["password", "Api_Key", "apikey", "TOKEN", "secret", ": ", " = ", '"', "'", "=", "abc", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef" * 2, " ", "\n", "é", "token=token=", "ſecret=abcdefg"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert secrets.base_spans(text) == _brute(text)


def test_structures_are_confirmed_and_noise_is_not():
    rng = random.Random(2)
    key = _rsa_key(rng)
    plain = base64.b64encode(key).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(plain[i : i + 64] for i in range(0, len(plain), 64)) + "\n-----END RSA PRIVATE KEY-----"
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51))
    text = f"é {_signed()} then {plain} and {pem} or {base64.b64encode(ssh).decode()} as hex {key.hex()} end"
    found = secrets.confirmed_spans(text)
    assert {k: len(v) for k, v in found.items()} == {"token": 1, "pem": 1, "der": 2, "openssh": 1}
    assert text[slice(*found["token"][0])] == _signed()
    assert text[slice(*found["pem"][0])] == pem
    noise = " ".join([base64.b64encode(rng.randbytes(200)).decode(), rng.randbytes(60).hex(), "eyJhbGciOi.eyJ4IjoxfQ.abc", _signed().replace("eyJ", "eyI")])
    assert not any(secrets.confirmed_spans(noise).values())
    broken = bytearray(key)
    broken[5] ^= 0x40  # a nested length
    assert not any(secrets.confirmed_spans(base64.b64encode(bytes(broken)).decode()).values())


def _wrap(data, width=64):
    body = base64.b64encode(data).decode()
    return "\n".join(body[i : i + width] for i in range(0, len(body), width))


def test_wrapped_keys_without_marks():
    rng = random.Random(5)
    for _ in range(30):
        key = _rsa_key(rng)
        for width in (64, 76):
            body = _wrap(key, width)
            for text in (f"here:\n{body}\nWord after", f"{body}", body.replace("\n", "\r\n") + "\r\n", f"  {body.replace(chr(10), chr(10) + '  ')}\nend of it"):
                (a, b), = secrets.confirmed_spans(text)["der"]
                assert "".join(text[a:b].split()) == body.replace("\n", "")
    noise = "\n".join(base64.b64encode(rng.randbytes(48)).decode() for _ in range(40))
    assert not any(secrets.confirmed_spans(noise).values())
    assert not any(secrets.confirmed_spans("x" * 40 + "\n" + "plain words\n" * 50).values())


def test_encrypted_keys():
    rng = random.Random(6)
    algorithm = _der(0x30, _der(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 1, 5, 13])) + _der(0x30, _der(4, rng.randbytes(8))))
    key = _der(0x30, algorithm + _der(4, rng.randbytes(160)))
    assert secrets.is_der_key(key) and not secrets.is_der_key(_der(0x30, _der(0x30, _der(2, b"\x01")) + _der(4, rng.randbytes(160))))
    text = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{_wrap(key)}\n-----END ENCRYPTED PRIVATE KEY-----"
    assert secrets.confirmed_spans(text)["pem"] == [(0, len(text))]
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    old = lambda size: f"-----BEGIN RSA PRIVATE KEY-----\n{head}{_wrap(rng.randbytes(size))}\n-----END RSA PRIVATE KEY-----"
    assert secrets.confirmed_spans(old(320))["pem"] == [(0, len(old(320)))]
    assert not any(secrets.confirmed_spans(old(321)).values())  # no whole blocks
    assert not any(secrets.confirmed_spans(old(320).replace("Proc-Type", "Comment")).values())


def test_rows(spark):
    text = f'Password: "hunter22" AKIA{"A1" * 8} {"ab12" * 6} {_signed()}'
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, None), (3, "", "y"), (4, "plain " * 40_000, "z")], "doc_id long, text string, spans string")
    rows = secrets.find_secrets(docs).collect()
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 1, 1)
    assert one.spans.split(",")[0] == "assign:0:19" and one.spans.split(",")[-1].startswith("token:")
    assert one.base == ",".join(x for x in one.spans.split(",") if not x.startswith("token"))
    assert "hunter22" not in one.redacted and "[token]" in one.redacted
    assert sorted(r.spans for r in rows if r.doc_id != 1) == ["", "", ""] and len(rows) == 5
    clean = docs.select(secrets.redaction(spark)("text").alias("t")).collect()
    assert [r.t for r in clean][2:4] == [None, ""] and clean[0].t == one.redacted
    assert secrets.find_secrets(docs.where("false")).count() == 0


def test_overlapping_spans_are_one_redaction():
    assert secrets.redacted("0123456789", [(1, "assign", 5), (3, "hex", 7), (8, "hex", 9)]) == "0[assign]7[hex]9"
