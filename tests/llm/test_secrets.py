"""The lexer of the secret scan: forms, references and long distances."""

import random
import time

import pytest

from wordtide.llm import secrets

VALUE = "q7!Zp-40xY"


def found(text):
    return {text[a:b] for a, _, b, *_ in secrets.all_spans(text)[1]}


@pytest.mark.parametrize(
    "text",
    [
        f'DB_PASS = "{VALUE}"',
        "\n".join([f'n0 = "{VALUE}"', *(f"n{i} = n{i - 1}" for i in range(1, 10)), "db_pwd = n9"]),
        "\n".join([f'n0 = "{VALUE}"', *(f"n{i} = n{i - 1}" for i in range(1, 5000)), "db_pwd = n4999"]),
        f'db_pwd ={" " * 40}"{VALUE}"',
        f'db_pwd = """{VALUE}"""',
        f"db_pwd = '''{VALUE}'''",
        f'cfg["db_pwd"] = "{VALUE}"',
        f"cfg['db_pwd' ] = '{VALUE}'",
        f"export DB_CREDENTIAL={VALUE}\n",
        f'x = "{VALUE}"; db_pwd = x; x = "hello world"',
        f'db_pwd = later\nlater = "{VALUE}"',
        f'a = b + b\nb = "{VALUE}"\ndb_pwd = a',
        f'{"n" * 400}_db_pwd = "{VALUE}"',
        f'db_pwd: Text = "{VALUE}"',
        f"<db_pwd>{VALUE}</db_pwd>",
        f"DB_CREDENTIAL: {VALUE}.",
    ],
)
def test_values_of_sensitive_names_are_found(text):
    assert VALUE in found(text)


def test_reassigned_names_do_not_mark_later_values():
    assert found(f'x = "{VALUE}"; db_pwd = x; x = "hello world"') == {VALUE}


def test_circles_and_doublings_end():
    assert found("db_pwd = a\na = b\nb = a") == set()
    lines = [f"n{i} = n{i + 1} + n{i + 1}" for i in range(60)]
    assert found("\n".join([*lines, f'n60 = "{VALUE}"', "db_pwd = n0"])) == {VALUE}


@pytest.mark.parametrize("unit", [":", "a:", "= ", "x = ", "a=b;", ">>", '"', "'''", "$", "name      "])
def test_time_grows_with_the_length(unit):
    start = time.perf_counter()
    secrets.all_spans(unit * 40_000)
    assert time.perf_counter() - start < 10


def test_random_programs():
    """Names are assigned, passed on and joined at random; what ends in a sensitive name is known."""
    draw = random.Random(8)
    for _ in range(60):
        held, lines, expected = {}, [], set()
        for step in range(draw.randint(3, 25)):
            name = f"{draw.choice(['alpha', 'beta', 'gamma', 'delta'])}{draw.randint(0, 2)}"
            if held and draw.random() < 0.5:
                parts = [draw.choice(sorted(held)) for _ in range(draw.randint(1, 2))]
                lines.append(f"{name} = {' + '.join(parts)}")
                held[name] = set().union(*(held[p] for p in parts))
            else:
                value = "".join(draw.choice("abcdefXYZ0123456789-!") for _ in range(14)) + "aB3!"
                lines.append(f'{name} = "{value}"')
                held[name] = {value}
            if draw.random() < 0.3:
                source = draw.choice(sorted(held))
                lines.append(f"{draw.choice(['db_pwd', 'cfg.passphrase', 'APP_CREDENTIALS'])} = {source}")
                expected |= held[source]
        assert found("\n".join(lines)) == expected
