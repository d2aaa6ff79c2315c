import random
import re

from treeloom.llm import subjects

TEXT = "# The verdict\n\n" + "\n\n".join(f"A judge came; the attorney left in day {i}. Nothing else was right." for i in range(50))


class _Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.pattern, name)


def test_plain_text_passes_by_the_patterns_of_what_it_lacks(monkeypatch):
    """Code, joined words and headings are looked for in every document; a text without them shouldn't pay for that."""
    lex, model, read = subjects.Lexicon(), subjects.Model(), []
    patterns = {name: _Counted(getattr(subjects, name)) for name in ("_FENCE", "_CODE_LINE", "_WORDS")}
    for name, p in patterns.items():
        monkeypatch.setattr(subjects, name, p)
    whole = lex.read
    monkeypatch.setattr(lex, "read", lambda s: read.append(s) or whole(s))
    got = subjects.votes(TEXT, lex, model)
    assert len(got) == 50 and all(v == {"law": 1 | 4} for v in got)
    assert read == ["The verdict"]  # a heading once, however many paragraphs are under it
    assert {name: p.calls for name, p in patterns.items()} == {"_FENCE": 0, "_CODE_LINE": 0, "_WORDS": 0}


def _words(lex, sentence):
    low = sentence.lower()
    for t in subjects._FIGURE_WORDS.intersection(subjects._WORDS.findall(low)):
        low = subjects._FIGURE_AT[t].sub(" ", low)
    return subjects._WORDS.findall(low)


def _found(lex, words):
    """Longest phrases from the left, then the words of the languages that the sentence has two marks of."""
    found, used, free = [], set(), 0
    for i, w in enumerate(words):
        for phrase, names, term in lex.first.get(w, ()) if i >= free else ():
            if tuple(words[i : i + len(phrase)]) == phrase:
                found += [(s, term) for s in names]
                used.update(phrase)
                free = i + len(phrase)
                break
    for w in set(words) & lex.foreign:
        found += [(s, w) for lang, s in lex.other[w] if sum(x in lex.marks[lang] for x in words) >= 2]
    return set(found), used


def _prose(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = subjects._TICKS.sub(" ", subjects._CODE_LINE.sub("", subjects._FENCE.sub("\n\n", text)))
    for p in re.split(r"\n[ \t]*\n", text):
        p = p.strip()
        if p.startswith("#"):
            p = p.partition("\n")[2]
        if p.strip():
            yield [s for s in re.split(r"(?<=[.!?])\s+|\n", p) if s.strip()]


def test_odd_text_is_read_as_the_patterns_say():
    rng, lex = random.Random(5), subjects.Lexicon()
    signs = ["\n", "\n\n", "\n \t\n", "\r\n", "\r", ". ", "! ", "?\n", "...\n", ".\x1c", " . ", "```\n", "\n~~~\n", "\n> ", "\n    ", "\n\t", ";", "; \n", "{\n", "}\n\n\n", "`", "'", "’", "-", "--", "É", "İ", "ΑΣ. ", "٣", "½", "_", "7", "\n# ", "\n#\n", "=", " ", "\x85"]
    words = [w for v in lex.first.values() for phrase, _, _ in v for w in (" ".join(phrase), phrase[0])] + [*lex.foreign] + [w for v in lex.marks.values() for w in v] * 4
    turns = ["it strikes a chord ", "rocket science ", "the jury is still out ", "a pinch of salt "]
    for _ in range(1500):
        text = "".join(rng.choice((rng.choice(signs), rng.choice(words) + rng.choice((" ", " ", "-", "'s ", ". ")), rng.choice(words).capitalize() + " ", rng.choice(turns))) for _ in range(rng.randrange(1, 60)))
        got = subjects.paragraphs(text)
        assert [s for _, s, _ in got] == list(_prose(text)), repr(text)
        for _, sentences, _ in got:
            for s in sentences:
                assert lex.words(s) == _words(lex, s), repr(s)
                found, used = lex.match(lex.words(s))
                assert (set(found), used) == _found(lex, lex.words(s)), repr(s)
