"""Operators on one text at a time, against brute force, the library or a round trip."""

from __future__ import annotations

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import language, main_text, personal_data, pieces, token_counts
from quillstream.llm.queries import vocabulary

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789..--  @@++ab_%é()", "4111 1111 1111 1111", "a.b@c.d", "1.2.3.4", "+1 (555) 123-4567", "iban: ", "account no. ", "://"]), max_size=30).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in personal_data.find_spans(text) if s[0] in personal_data.KINDS] == base_spans(text)


def test_added_spans_and_redaction():
    text = "IBAN GB82 WEST 1234 5698 7654 32; account no. 12345678, http://bob:pw@x.org SSN 123-45-6789"
    assert [s[0] for s in personal_data.find_spans(text) if s[0] in personal_data.ADDED] == ["login", "iban", "account", "ssn"]
    assert personal_data.redacted("Mail a.b@c.de or +1 (555) 123-4567!") == "Mail <email> or <phone>!"
    assert personal_data.find_spans(None) == [] and personal_data.redacted(None) is None
    assert personal_data.find_spans("IBAN GB82 WEST 1234 5698 7654 33") == []


def test_secrets_and_long_logins():
    cases = {'TOKEN = "9233A8ECF7C5"': "9233A8ECF7C5", "password: hunter22x": "hunter22x", "api_key='abcd1234'": "abcd1234", "secret=>s3cr3tvalue,": "s3cr3tvalue", "Bearer: 12345678": "12345678"}
    for text, value in cases.items():
        assert [(k, text[a:b]) for k, a, b in personal_data.find_spans(text) if k == "secret"] == [("secret", value)]
    for text in ("the secret of success", "tokens = 3", "a password is needed", "mytoken = 12345678"):
        assert not [s for s in personal_data.find_spans(text) if s[0] == "secret"]
    assert personal_data.find_spans("http://" + "u" * 70 + ":p@x.org")[-1] == ("login", 7, 79)


def test_many_languages_keep_their_numbers():
    n = 200
    scores = np.full((6, n), -50.0, np.float32)
    scores[:3, 150] = scores[3:, 180] = 0.0
    assert language._paths(scores, np.array([0, 6]), 1.0).tolist() == [150] * 3 + [180] * 3


@pytest.fixture(scope="module")
def sp():
    return pieces.load(vocabulary("piece_bpe_32k.model"))


def test_words_searched_together_and_alone_are_alike(sp):
    rng = random.Random(4)
    letters = "etaoinshrdlu" * 4 + "ABCxyz.,'-0189éßждあ漢😀\ud800" + pieces.SPACE
    words = [pieces.SPACE * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, numbers = sp.best(words)
    for w, i, (n, score, gap) in zip(words, ids, numbers.tolist(), strict=True):
        assert (i, score, gap) == sp.second(w) and n == len(i) // 4


def test_alternatives_of_a_very_long_word(sp):
    rng = random.Random(5)
    w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    tracemalloc.start()
    ids, score, others = pieces.encode(w, sp)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert pieces.decode(ids, sp) == w and len(others) == pieces.N_BEST - 1 and all(s <= score for s, _ in others)


@pytest.fixture(scope="module")
def bpe():
    return token_counts.load(vocabulary("word_bpe_49k.json"))


def test_token_counts_are_those_of_the_library(bpe):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = [*"aabbcdehlst'smrvedll  \t\n\x0b\x1c\x85\xa0 éÉÀÇßſİIıΣσςÅÅ漢字かな한글😀²¼①٣Ⅷ_-<|>.,!?#ǅﬁ𝔸́\u0000", "<|startoftext|>", "<|endoftext|>", "aaaaaaa", "hahahaha", "ΑΣ"]
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)), "a" * 5000, "the cat sat " * 3000]
    assert token_counts.count_tokens(texts, bpe) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens([None], bpe) == [0]


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(vocabulary("piece_bpe_32k.model"))


def every_path(text: str, p: pieces.Pieces) -> list[tuple[float, tuple[int, ...]]]:
    word = pieces.SPACE + text.replace(" ", pieces.SPACE)
    edges, out = p.edges(word), []

    def back(j: int, ids: tuple[int, ...], score: float) -> None:
        if not j:
            out.append((score, ids))
        for i, own, s in edges[j]:
            back(i, own + ids, score + s)

    back(len(word), (), 0.0)
    return out


def test_best_paths_are_those_of_brute_force(vocab):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice([*"abehinorst  \n", "漢", "é", "☃", "the", "ing", " and", "▁"]) for _ in range(rng.randint(1, 6)))
        every = every_path(text, vocab)
        ids, score, others = pieces.encode(text, vocab, 4)
        assert [score] + [s for s, _ in others] == sorted((s for s, _ in every), reverse=True)[:4]
        paths = [tuple(ids.tolist())]
        for _, changes in others:
            x = ids.tolist()
            for place, replaced, own in sorted(changes, reverse=True):
                x[place : place + replaced] = own
            paths.append(tuple(x))
        assert len(set(paths)) == len(paths) and set(paths) <= {p for _, p in every}


def test_encoding_round_trip(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for text in ["", " ", "a", "  two  spaces ", "tab\tline\nend", "漢字 ☃ ﬁ é", "x" * 3000, "le la " * 2000]:
        ids, _, _ = pieces.encode(text, vocab)
        assert pieces.decode(ids, vocab) == text and sp.decode(ids.tolist()) == text
    assert pieces.encode(None, vocab)[1:] == (0.0, [])


def test_viterbi_is_that_of_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sizes = rng.integers(1, 7, size=rng.integers(1, 4))
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = (rng.normal(size=(first[-1], 3)) * 4).astype(np.float32)
        path = language._paths(scores, first, 5.0)
        for d in range(len(sizes)):
            s = scores[first[d] : first[d + 1]].astype(float)
            value = lambda q: sum(s[i, k] for i, k in enumerate(q)) - 5.0 * sum(a != b for a, b in zip(q, q[1:]))  # noqa: B023, E731
            assert abs(value(path[first[d] : first[d + 1]].tolist()) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-3


def test_words_and_scripts():
    assert language.words_in("L'été 123 _x ß") == ["l", "été", "x", "ß"]
    assert language.words_in("Привет мир") == ["привет", "мир"]
    assert language.words_in(None) == []


def test_main_text_of_broken_pages():
    read = lambda page: main_text.own_text(page, set())
    assert read(None) == "" and read("") == "" and read("<p>a<!-- x") == "a"
    page = '<div class=menu>x</div><h1>T &amp; u</h1>a <b>b</b>\n c<br>d<p>q<p>r<form>f</form><section class="comments"><p>nice</p></section><script>if(a<b){"</p>"}</script><p>1 < 2<ul><li>i<li>j</ul>'
    assert read(page) == "T & u\na b c d\nq\nr\n1 < 2\ni\nj"
    assert read("<p>out</p><article><header><h1>H</h1></header><p>in</p><footer>f</footer></article><aside>s</aside>") == "H\nin"
