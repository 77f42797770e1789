import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm.tokens import PrefixCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "it's  a test", "it's   a <|endoftext|> x", "don't\n\n  go\tnow's", "é 中文 x", "a\x1c b\xa0c\x85 d", "  \n x  ", "'s't 'S x'", "x" * 5000, "1234567 ½ ²", "naïve ŒUVRE ßs", "🙂🙂 ok", " ", "\n\n\n"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda t: len(made.encode(t, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, library):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(99, None, "x"), (0, "a b", "x")], "doc_id long, text string, n_tokens string")
    rows = token_counts(docs, PATH, store=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a b" if r.doc_id == 0 and r.n_bytes else (TEXTS[r.doc_id] if r.doc_id < 99 else "")
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 1024)
        assert r.counts[-1] == r.n_tokens and r.ends[-1] == len(text)


def test_prefixes_answer_without_encoding_again(library):
    own = PrefixCounter(PATH)
    text = "Some words here, don't they?  And numbers 12345 too."
    ends, counts = own.prefixes(text)
    assert all(library(text[:e]) == c for e, c in zip(ends, counts, strict=True))
    for budget in range(library(text) + 2):
        cut = own.truncate(text, budget)
        assert library(cut) <= budget and (cut == text or library(text[: ends[ends.index(len(cut)) + 1]]) > budget)


def test_every_prefix_of_a_piece(library):
    own = PrefixCounter(PATH)
    for piece in (" antidisestablishmentarianism", "héllo", "!!!???", "1234567", "zzqxj"):
        counts = own.inner(piece)
        assert all(counts[len(piece[:k].encode())] == library(piece[:k]) for k in range(len(piece) + 1))


def test_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_budgets_in_texts_of_any_script_and_in_one_piece(spark, library):
    own = PrefixCounter(PATH)
    texts = ["“Quoted” — text… " * 300, "語言模型" * 800, "Слова и числа 12 " * 400, "x" * 5000, "ab<|endoftext|>cd  \n " * 300, "🙂" * 900, " \n\t" * 1500 + "b", " " * 3000 + "end", "a  \n\tb c " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts(docs, PATH, limit=300).collect():
        text, n = texts[r.doc_id], r.fit_chars
        assert r.n_tokens == library(text) and r.over_limit == (library(text) > 300)
        assert library(text[:n]) <= 300 and (n == len(text) or n > 0)
        assert n == len(text) or library(text[: n + 1]) > 300
    for text in texts:
        for budget in (3, 7, 50):
            assert 0 < len(own.truncate(text, budget)) <= own.fit(text, budget) and library(own.truncate(text, budget)) <= budget
            assert all(library(text[:k]) > budget for k in range(own.fit(text, budget) + 1, min(len(text), own.fit(text, budget) + 20)))


def test_plain_texts_are_split_like_the_library():
    own = PrefixCounter(PATH)
    plain = [c for c in map(chr, range(0x2B0)) if own.is_plain(c)]
    assert len(plain) > 600
    for c in plain:
        text = f"x{c} {c}1{c}{c}\n {c}'s{c}"
        assert own.split(text) == [text[a:b] for _, (a, b) in own.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_starts_that_pieces_share_are_counted_once():
    own, alone, steps = PrefixCounter(PATH), PrefixCounter(PATH), 0
    words = [" zqxjstart" + tail for tail in ("", "a", "ab", "abc", "abd", "b", "bé", "é", "er", "ers")] + ["x" * 3000, "zq", " zq"]

    class Spied(dict):
        def get(self, part):
            nonlocal steps
            steps += 1
            return super().get(part)

    own.starts = Spied(own.starts)
    text = "".join(words)
    (total, fit, known), (again, _, none) = own.rows([text, " zqxjstartab"], 7, True)
    assert all(own.known[w] == alone.inner(w)[-1] for w in words if len(w) <= 2000) and "x" * 3000 not in own.known
    assert total == len(alone.tokenizer.encode(text, add_special_tokens=False).ids) and again == alone.inner(" zqxjstartab")[-1]
    assert (known, fit) == (alone.prefixes(text), alone.fit(text, 7)) and none == alone.prefixes(" zqxjstartab")
    own.known.clear()
    steps = 0
    own.learn(set(words[:10]))
    together, steps = steps, 0
    for w in words[:10]:
        own.inner(w)
    assert together * 5 < steps * 3
