import random
import shlex

from runlens.operators import readers


def lexed(line):
    lexer = shlex.shlex(line, posix=True, punctuation_chars="|&;<>()")
    lexer.whitespace_split = True
    return list(lexer)


def test_words_of_a_line_are_those_of_the_lexer():
    rng = random.Random(5)
    for _ in range(5000):
        line = "".join(rng.choice("ab-=./$ \t\r|&;<>()# é\x0b") for _ in range(rng.randrange(14)))
        assert readers.shell_words(line) == lexed(line)
    assert readers.shell_words("cat 'a b.csv' x\\ y.csv") == ["cat", "a b.csv", "x y.csv"]


def test_plain_lines_take_no_lexer(monkeypatch):
    monkeypatch.setattr(readers.shlex, "shlex", None)
    assert readers.read_shell("# fit\npython fit.py --data in/1.csv \\\n  --out=out/1.json > log.txt\n") == [("fit.py", "runs", "static"), ("in/1.csv", "reads", "static"), ("out/1.json", "writes", "static"), ("log.txt", "writes", "static")]
