"""Secret scan: literals in layouts without bounds."""

from __future__ import annotations

import time

import pytest

from .test_secrets import literals, s

SECRET = "Zk38fhQ1x9Lm"


@pytest.mark.parametrize(
    "text,found",
    [
        (f'db_pwd            = "{SECRET}"', [SECRET]),
        (f'db_pwd ={" " * 5000}"{SECRET}"', [SECRET]),
        (f'client_credential_{"x" * 200} = "{SECRET}"', [SECRET]),
        ("private_key = " + " + ".join(f'"Zk{i}q"' for i in range(100)), [f"Zk{i}q" for i in range(100)]),
        ('private_key = "Zk38fhQ1" +\n    "x9LmPq"', ["Zk38fhQ1", "x9LmPq"]),
        ('private_key = ("Zk38fhQ1"\n    + "x9LmPq")', ["Zk38fhQ1", "x9LmPq"]),
        ('private_key = "Zk38fhQ1" + \\\n    "x9LmPq"', ["Zk38fhQ1", "x9LmPq"]),
        ('base = "Zk38fh"\nclient_pwd = base + base', ["Zk38fh"]),
        ('- pwd = "Zk38fhQ1x9Lm"\n+ pwd = "Yk38fhQ1x9Ln"', [SECRET, "Yk38fhQ1x9Ln"]),
        (f'client_credential: string = "{SECRET}"', [SECRET]),
        (f'client_credential: Optional[str] = "{SECRET}"', [SECRET]),
        (f'const PRIVATE_KEY: &\'static str = "{SECRET}"', [SECRET]),
        (f'client_credential: string | null = "{SECRET}"', [SECRET]),
        (f'def f(pwd: str="{SECRET}"):', [SECRET]),
        ('label: string = "Zk38fhQ1x9Lm"\nclient_credential: string', []),
        ("credential: Zk38fhQ1x9LmAbCd=\nother", ["Zk38fhQ1x9LmAbCd="]),
        *[(f'db_pwd = {p}"{SECRET}"', [SECRET]) for p in ("b", "f", "r", "rb", "u", "u8", "@", "$")],
        (f'db_pwd = """{SECRET}"""', [SECRET]),
        (f"db_pwd = r'''{SECRET}'''", [SECRET]),
        (f'db_pwd = """{SECRET}', []),
    ],
)
def test_layouts(text, found):
    assert literals(text) == found


@pytest.mark.parametrize(
    "text",
    [
        "pwd = 'aB3dE5gH'\n" + "pwd = pwd + pwd\n" * 3000,
        "pwd = 'aB3dE5gH'\n" + "pwd = pwd + 'x'\n" * 3000,
        "a" * 300_000 + " " * 300_000,
        ("pwd" + " " * 300) * 2000,
        "pwd: a[" * 60_000,
        'pwd = """' * 1 + "pwd = '''x " * 30_000,
        "pwd = 'x'" + "\n" * 300_000,
        "pwd = " + "(" * 300_000,
    ],
)
def test_time_is_linear(text):
    start = time.process_time()
    s.digest(text)
    assert time.process_time() - start < 10
