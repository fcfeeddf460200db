"""Secret scans: base patterns against plain loops, pairs and constants on small sources."""

from __future__ import annotations

import hashlib
import re
import time

import pytest

from brimwatch.llm import secrets

CASES = [
    ('pass_word = 1\npassword = "Hunter2!xyz9"', ["Hunter2!xyz9"]),
    ('{"apiKey": "ab12cd34ef56gh78", "keyName": "whatever123"}', ["ab12cd34ef56gh78"]),
    ('KEY = "ab12CD34ef56"\nx = 3\nclient_secret = KEY', ["ab12CD34ef56"]),
    ('A = "abc123"\nB = A + "DEF456"\npassword = B', ["abc123", "DEF456"]),
    ('v["db_password"] = "tr0ub4dor&3"', ["tr0ub4dor&3"]),
    ('const authToken: string = "eyJhbGciOiJIUzI1"', ["eyJhbGciOiJIUzI1"]),
    ("export VAULT_SECRET_KEY=wJalrX7tnFEMI/K7MDENG", ["wJalrX7tnFEMI/K7MDENG"]),
    ("<conf><password> c0rrect-H0rse </password></conf>", ["c0rrect-H0rse"]),
    ("tool --password S3cure#99 -v", ["S3cure#99"]),
    ("password: ${DB_PASS}\nDB_PASS=qwer7890TY", ["qwer7890TY"]),
    ('self.secret_key = (\n  "abc123XYZ"\n  "def456")', ["abc123XYZ", "def456"]),
    ('token = """line1\nx9"""', ["line1\nx9"]),
    ("pwd = 'it''s'", []),
    ('passphrase := `q1w2e3R4T5`', ["q1w2e3R4T5"]),
    ('password = os.environ["DB_PASS"]', []),
    ("the password: please do not forget it", []),
    ('password = "changeme"', []),
    ('if password == "abcDEF123": go()', []),
    ("don't say token: it's fine", []),
    ("max_token_length: 123456789", []),
    ('monkey = "abcdef123456"', []),
    ("password = A\nA = password", []),
    ("password = password", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_pairs(text, want):
    assert [text[a:b] for a, b in secrets.lexed(text)] == want


def plain(text):
    """Base spans by maximal runs instead of searches, and the assignments by a reader of its own."""
    out = []
    for kind, signs, least in (("access", r"[A-Z0-9]", 20), ("hex", r"[0-9a-f]", 24)):
        i = 0
        while i < len(text):
            j = i
            while j < len(text) and re.fullmatch(signs, text[j]):
                j += 1
            start = text.find("AKIA", i, j) if kind == "access" else i
            if 0 <= start and j - start >= least:
                out.append((start, ("access", "hex").index(kind) + 1, kind, j))
            i = max(j, i + 1)
    i, low = 0, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while i < len(text):
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if not low.startswith(word, i):
                continue
            j = i + len(word)
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                if k - j >= 6:
                    out.append((i, 0, "assign", k))
                i = k - 1
                break
        i += 1
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_base(spark, data, messy, nothing):
    odd = [
        (1001, "secret:token:abcdefgh TOKEN='ab.cdefg' ſecret=abcdef123 toKen=abcdefg api_key\": \"A+/_.=-x"),
        (1002, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAAKIA" + "C7" * 8 + " 0123456789abcdef01234567 " + "F" * 30),
        (1003, "é😀 password=ééé secret = = abcdefgh password:'" + "a1" * 40),
    ]
    docs = (
        spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
        .unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
        .unionByName(messy.select("doc_id", "text").where("doc_id <> 9 AND doc_id <> 10"))
    )
    got = sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.secret_spans(docs).collect())
    want = []
    for r in docs.collect():
        spans = plain(r.text or "")
        counts = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        want.append((str(r.doc_id), hashlib.sha256(",".join(spans).encode()).hexdigest(), *counts))
    assert got == sorted(want)
    assert sum(w[2] for w in want) >= 4
    assert secrets.secret_spans(nothing).collect() == []


def test_spans(spark):
    text = 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" K'
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == "assign:2:51,hex:11:51,literal:11:51" and row.n_literal == 1


def test_hostile_texts_take_linear_time():
    names = "".join(f"a{i} = a{i + 1} + a{i + 1}\n" for i in range(3000))
    for part in ("'" * 200_000, '"""' * 50_000, 'a="' * 50_000, '"' + '\\"' * 100_000, "password = a+" * 20_000, names):
        begin = time.process_time()
        secrets.lexed("password = a0\n" + part)
        assert time.process_time() - begin < 15
