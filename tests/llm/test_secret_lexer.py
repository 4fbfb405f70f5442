"""The assignment-aware lexer: syntax, references, names that only describe, and texts made to be slow."""

import random
import time

import pytest

from voxspark.llm import secret_scan

V = "x7GkQ2mPz9"
CASES = [
 ('{"auth": {"token": "aB3dE5fG7h"}}',["aB3dE5fG7h"]),('s3 = {"secret_access_key": "wJalrXU7t5"}',["wJalrXU7t5"]),("config['api_key'] = 'x7GkQ2mPz9'",[V]),('db_password:\n  x7GkQ2mPz9\n',[V]),('db_password:\n  "x7GkQ2mPz9"\n',[V]),
    ('run --password x7GkQ2mPz9 --user bob',[V]),('run --password=x7GkQ2mPz9',[V]),('run --password "x7GkQ2mPz9"',[V]),('private_key: |\n  x7GkQ2mPz9aa\n  b8HlR3nQa0bb\nuser: z',["x7GkQ2mPz9aa","b8HlR3nQa0bb"]),
    ('<add key="Password" value="x7GkQ2mPz9"/>',[V]),('- name: DB_PASSWORD\n  value: x7GkQ2mPz9\n',[V]),('{"name": "DB_PASSWORD", "value": "x7GkQ2mPz9"}',[V]),
    ('foreign_key = "users.account_id"',[]),('sort_key="created_at1"',[]),('primary_key: "customer_id_1"',[]),('keyboard_key = "ArrowLeft1"',[]),('api_docs_key = "Section heading here"',[]),
    ('connect(host="h1xxxxxx", password="x7GkQ2mPz9", port=5)',[V]),('tokens = ["x7GkQ2mPz9",\n  "b8HlR3nQa0"]',[V,"b8HlR3nQa0"]),('password: Optional[str] = "x7GkQ2mPz9"',[V]),('x = os.environ["API_KEY"]',[]),('token = os.environ["MY_TOKEN_1a"]',[]),
    ('const cfg = {\n  user: "bob12345x",\n  password: "x7GkQ2mPz9",\n};',[V]),('password = (\n  "x7GkQ2m"\n  "Pz9aBc1"\n)',["x7GkQ2m","Pz9aBc1"]),('token_type = "bearer12X"',[]),('if password == "x7GkQ2mPz9":',[]),
    ('password=abc123X/yz+==\n',['abc123X/yz+==']),('secret_key=$x7GkQ2mPz',['$x7GkQ2mPz']),('password: 9x7GkQ2mPz',['9x7GkQ2mPz']),('a: {b: 1}\npassword: x7GkQ2mPz9',[V]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_pairs(text, want):
    assert [text[a:b] for a, b in secret_scan.target_spans(text)] == want
    once = secret_scan.redact(text)
    assert secret_scan.redact(once) == once and not any(w in once for w in want)


def test_linear_in_the_text():
    began = time.process_time()
    doubling = 'v0 = "x7GkQ2mPz9"\n' + "".join(f"v{i} = v{i - 1} + v{i - 1}\n" for i in range(1, 2_000)) + "db_password = v1999\n"
    assert [doubling[a:b] for a, b in secret_scan.target_spans(doubling)] == [V]
    appends = 's = "x1"\n' + 's = s + "aB3dE5fG"\n' * 60_000 + "password = s\n"
    assert len(secret_scan.target_spans(appends)) == 60_000
    for part in "([{\"'`=:-\n<$":
        secret_scan.target_spans(f"password{part}" * 30_000)
        secret_scan.target_spans(part * 200_000 + " key")
    assert time.process_time() - began < 60


@pytest.mark.parametrize(("head", "part"), [("", "password="), ('password = "x7GkQ2mPz9" ', "a/"), ("", "password=a.=.")])
def test_long_runs_without_blanks_take_linear_time(head, part):
    def seconds(n):
        began = time.process_time()
        secret_scan.target_spans(head + part * n)
        return time.process_time() - began

    assert min(seconds(16_000) for _ in range(3)) < 8 * min(seconds(4_000) for _ in range(3))


def test_values_padded_with_equals_signs():
    for text, want in (("password=aB3dE5==", ["aB3dE5=="]), ("password=aB3dE5=..", ["aB3dE5="]), ("password=aB3dE5..", ["aB3dE5"]), ("password=aB3dE5=.x", []), ("password=aB3dE5.=", ["aB3dE5.="])):
        assert [text[a:b] for a, b in secret_scan.target_spans(text)] == want


def test_random_token_soup():
    rng = random.Random(0)
    parts = ["password", "=", ":", '"', "'", "{", "}", "(", ")", "[", "]", "\n", " ", "a", "b1Xy9Zq", "key", "--", "|", "${", "<", ">", ",", "token", '"x7GkQ2mPz9"']
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        spans = secret_scan.target_spans(text)
        assert all(0 <= a < b <= len(text) for a, b in spans) and spans == sorted(set(spans))
        secret_scan.redact(text)
