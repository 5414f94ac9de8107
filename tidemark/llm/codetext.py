"""Natural language in comments and string literals, by function words of all languages in one pass."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is are was were be been that this these those it its with for on at by from as or not but if then than so we you they he she our your their there which who what when where because before after although without while into until since only every each two some any no can could should will would has have had do does did must may",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde hat haben mit von vom zu zum zur für auf aus bei beim nach vor im in am an über unter durch ohne gegen seit bis wenn weil dass damit als wie so sich es er sie wir ihr auch nur noch schon sehr jede jeder jedes keine kein mehrere zwei drei trotz während wegen was wer wo sodass obwohl",
    "fr": "le la les un une des du de et ou mais ne pas est sont était été être avec pour dans sur sous par sans chez vers après avant depuis pendant malgré car que qui quoi dont où ce cet cette ces il elle ils elles nous vous on se son sa ses leur leurs au aux plus très si bien quand comme chaque deux trois plusieurs seulement uniquement dès lors l d qu n s",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ser está están con para por en sobre sin desde hasta tras antes después durante porque que quien cual donde cuando como si se su sus lo al más muy este esta estos estas eso cada dos tres varias varios solo aunque ya nunca también entre",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são era foi ser está com para por em no na nos nas ao aos à sobre sem desde até após antes depois durante porque que quem qual onde quando como se seu sua seus suas mais muito este esta esse essa isso cada dois duas três vários várias somente apenas embora apesar já nunca também entre pelo pela",
    "it": "il lo la i gli le un uno una di del della dei delle dello degli e o ma non è sono era stato essere con per in nel nella nei nelle su sul sulla da dal dalla dall al alla ai alle senza dopo prima durante perché che chi cui dove quando come se si suo sua suoi loro più molto questo questa ogni due tre solo anche ancora mai fino tra prima dopo nonostante ha ho l un dell dall nell sull all quell",
    "nl": "de het een en of maar niet is zijn was waren wordt worden werd met van voor op in aan bij naar uit om over onder door zonder tegen sinds tot als omdat dat die dit deze wie wat waar wanneer hoe ik je hij zij ze wij we ook nog al zeer meer elke elk geen twee drie meerdere alleen ondanks tijdens na te nooit zodat hoewel",
    "sv": "och att det som en ett den de är var på av för med till från i om inte men eller han hon vi ni jag man sig sin sitt sina har hade ska skulle kan kunde blir när där här efter före under över utan mot sedan eftersom vid mer mycket varje två tre flera bara endast trots aldrig så än också ingen inget",
    "pl": "i w we z ze na do od po za o u oraz lub ale nie jest są był była było być się to ten ta te tego tej tym tych co kto który która które jak gdy kiedy gdzie że żeby ponieważ bez przed przy przez dla pod nad między podczas mimo każdy każda każde dwa dwie trzy kilka tylko już jeszcze bardzo więc dlatego jego jej ich my wy oni a powodu ponownym zbyt przeciw wszystkie",
    "tr": "ve ile bir bu şu o da de ki mi mı mu mü için gibi kadar göre sonra önce her hiç çok daha en ama fakat veya ya değil var yok olan olarak oldu ne nasıl neden nerede ben sen biz siz onlar üç iki bazı yalnızca sadece rağmen sırasında beri sonunda içinde üzerinde hem bile diye yeni eski yeniden tüm birkaç fazla geçen",
    "ru": "и в во на с со к ко по за из от до у о об для без при через под над между перед после что как где когда если потому чтобы не ни но или а же бы ли это этот эта эти тот та те он она оно они мы вы я его её их свой который которая которые был была было были есть только уже ещё очень каждый каждая каждую два две три несколько из-за несмотря поэтому во",
}
#: Letters beyond a-z of each language; they vote like function words, at half the weight.
LETTERS = {
    "de": "äöüß", "fr": "àâçèéêëîïôùûœ", "es": "áéíñóúü", "pt": "áâãàçéêíóôõú", "it": "àèéìòù", "nl": "ëïé", "sv": "åäö",
    "pl": "ąćęłńóśźż", "tr": "çğıöşü", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
}
_LETTER_VOTES = {c: tuple((x, 0.5 * math.log(1 + (len(FUNCTION_WORDS)) / sum(c in v for v in LETTERS.values()))) for x, v in LETTERS.items() if c in v) for c in "".join(LETTERS.values())}
#: Writing systems that settle the language by themselves: code, ranges.
SCRIPTS = {
    "ja": ((0x3040, 0x30FF),), "ko": ((0xAC00, 0xD7AF), (0x1100, 0x11FF)), "th": ((0x0E00, 0x0E7F),), "zh": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)),
}
#: Words of running text that a span must hold, and characters in a script without blanks.
MIN_WORDS, MIN_UNSPACED = 4, 6

_MARKS = re.compile(r"(?m)^\s*(?://+|/\*+|\*+/?|#+|--+|\"\"\"|''')|\*+/\s*$|(?:\"\"\"|''')\s*$")
#: Insertions that do not end a sentence: code in backticks, references in brackets.
_INSERT = re.compile(r"`[^`\n]*`|\b[a-z]+[A-Z][A-Za-z]*\d*\b|\([^()\n]{0,24}\)|\[[^\[\]\n]{0,24}\]")
_TAG = re.compile(r"@\w+[^\n]*|\b(?:TODO|FIXME|XXX|NOTE|HACK|NOSONAR)\b(?:\([^)\n]*\))?(?:\s+[\w-]*\d[\w-]*)?:?")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
#: Where a run of text ends: sentence marks, or characters that stand in code, paths and lists of names.
_BREAK = re.compile(r"[.!?…](?:\s|$)|\n\s*\n|[={}<>\[\]|\\/@#$%^*+~_&;()`]|\s--+|--+\s|::|->|\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LATIN_LETTER = re.compile(r"[a-zA-Z]")
_CAPITALS = re.compile(r"\b[^\W\d_]{2,}\b(?<=[A-ZÀ-ÞА-Я]{2})")
_INNER_UPPER = re.compile(r"[a-zß-ÿ][A-Z]")


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn").translate(str.maketrans("łıøß", "lios"))


def automaton() -> ahocorasick.Automaton:
    """All function words, also without diacritics, with the votes of each: the fewer languages
    have a word, the more its vote counts."""
    of: dict[str, set[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            for form in {w, _bare(w)}:
                of.setdefault(form, set()).add(lang)
    a = ahocorasick.Automaton()
    for w, langs in of.items():
        # A bare form is weaker evidence where another language has it as its true form.
        a.add_word(w, (len(w), tuple((x, math.log(1 + len(FUNCTION_WORDS) / len(langs)) * (1.0 if w in FUNCTION_WORDS[x].split() else 0.6)) for x in sorted(langs))))
    a.make_automaton()
    return a


def votes(auto: ahocorasick.Automaton, text: str) -> tuple[Counter, float]:
    """Votes by language, and the number of function words at word boundaries; a letter of few languages counts half."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: Counter = Counter()
    hits = 0
    n = len(low)
    for end, (length, langs) in auto.iter(low):
        start = end - length + 1
        if start and (low[start - 1].isalnum() or low[start - 1] == "_") or end + 1 < n and (low[end + 1].isalnum() or low[end + 1] == "_"):
            continue
        hits += 1
        for lang, w in langs:
            out[lang] += w
    for c in low:
        if c > "\x7f":
            of = _LETTER_VOTES.get(c, ())
            hits += 0.5 * bool(of)
            for lang, w in of:
                out[lang] += w
    return out, hits


def unspaced(text: str) -> Counter:
    out: Counter = Counter()
    for c in text:
        if c > "෿":
            o = ord(c)
            for lang, ranges in SCRIPTS.items():
                if any(a <= o <= b for a, b in ranges):
                    out[lang] += 1
    if out["ja"]:
        out["ja"] += out.pop("zh", 0)
    return out


def language(auto: ahocorasick.Automaton, text: str) -> tuple[str, int] | None:
    """(language of most words, words of running text) of a span, or None if it holds no sentence."""
    script = unspaced(text)
    if script and max(script.values()) >= MIN_UNSPACED:
        lang, n = max(sorted(script.items()), key=lambda x: x[1])
        return lang, n
    body = _TAG.sub(" . ", _MARKS.sub(" ", text))
    body = _INSERT.sub(" ", body)
    words_of: Counter = Counter()
    longest: Counter = Counter()
    for stretch in _BREAK.split(body):
        words = _WORD.findall(stretch)
        capitals = sum(w.isupper() and len(w) > 1 for w in words)
        if 0 < capitals < len(words):  # keywords and names, unless all is in capitals
            stretch = _CAPITALS.sub(" ", stretch)
            words = _WORD.findall(stretch)
        if len(words) < MIN_WORDS or sum(len(w) > 1 for w in words) * 3 < len(words) * 2:
            continue
        if sum(bool(_INNER_UPPER.search(w)) for w in words) * 3 > len(words):
            continue
        if len(stretch.split()) * 2 < len(words):  # words that dots or strokes join are a name
            continue
        score, hits = votes(auto, stretch)
        if not hits:
            continue
        lang, best = max(sorted(score.items()), key=lambda x: x[1])
        if hits * 8 < len(words):
            continue
        words_of[lang] += len(words)
        longest[lang] = max(longest[lang], len(words))
    if not words_of:
        return None
    lang, n = max(sorted(words_of.items()), key=lambda x: x[1])
    return lang, n


def resolved(text: str, raw: str | None) -> str:
    """A literal's text with its Unicode escapes read, where the raw form shows them."""
    if raw and "\\u" in raw:
        inner = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] else raw
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), _ESCAPE.sub(lambda m: chr(int(m[1], 16)), inner))
    if raw and "\\n" in raw:  # the dropped backslash of a line end leaves an n
        inner = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] else raw
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), inner)
    return text


def span_languages(spans: DataFrame) -> DataFrame:
    """(span_id, file_id, lang, words, chars) of the spans that hold natural language.

    ``spans`` has span_id, file_id, comment_text, literal_value and raw_text. One pass over each
    span, no shuffle; ``chars`` are those that it takes up in the file, without quotes. Spans without text, code, names and lists give no row; a span of several
    languages has that of most of its words, of equals the first by code.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton()
        for pdf in batches:
            out = []
            for sid, fid, comment, literal, raw, chars in zip(pdf["span_id"].tolist(), pdf["file_id"], pdf["comment_text"], pdf["literal_value"], pdf["raw_text"], pdf["chars"]):
                text = comment if comment is not None else resolved(literal, raw)
                found = language(auto, text)
                if found:
                    out.append((sid, None if pd.isna(fid) else int(fid), found[0], found[1], chars))
            yield pd.DataFrame(out, columns=["span_id", "file_id", "lang", "words", "chars"])

    inner = F.regexp_replace("raw_text", r"^(\"\"\"|'''|[\"'`])([\s\S]*)\1$", "$2")  # as it stands in the file, escapes and all, without its quotes
    held = spans.where("span_id is not null and (comment_text is not null or literal_value is not null)").select(
        "span_id", "file_id", "comment_text", "literal_value", "raw_text", F.length(F.coalesce("comment_text", inner, "literal_value")).cast("bigint").alias("chars"))
    return spread(held).mapInPandas(run, "span_id bigint, file_id bigint, lang string, words int, chars bigint")


def file_shares(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_id, file_chars, text_chars, share, main_lang) for every file: what natural language takes up of it."""
    by = span_languages(spans).where("file_id is not null").groupBy("file_id", "lang").agg(F.sum("chars").alias("chars"))
    per = by.groupBy("file_id").agg(F.sum("chars").alias("text_chars"), F.max_by("lang", F.struct("chars", "lang")).alias("main_lang"))
    size = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.coalesce(F.length("file_content"), F.lit(0))).cast("bigint").alias("file_chars"))
    n = F.coalesce("text_chars", F.lit(0)).cast("bigint")
    return size.join(per, "file_id", "left").select("file_id", "file_chars", n.alias("text_chars"), F.when(F.col("file_chars") > 0, F.round(F.least(n / F.col("file_chars"), F.lit(1.0)), 4)).otherwise(0.0).alias("share"), "main_lang")
