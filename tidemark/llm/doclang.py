"""Languages of documents and of their paragraphs by exact code lengths under PPM models."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import spread
from .ppm import Ppm

# Codes and English names of the languages that are told apart.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "sv": ("swe", "swedish"),
    "pl": ("pol", "polish"), "tr": ("tur", "turkish"), "ru": ("rus", "russian"),
}
CODES = list(LANGUAGES)

#: A few sentences in each language, so that a language without labelled rows has a model too.
SEED = {
    "en": "The people who live here have always known that there is more than one way to do it, and they are not afraid to try what others would not. When it was late, we went back to the house because nobody had told us where they were. If you want to see this, you should ask before the others come, although it has been a long day. We found the old letters under the table, where someone must have left them during the war. Each of these people has been working for a small company that sells wooden chairs, and most of their customers are from other countries. Could you please send us the report which we discussed yesterday? Nothing would make me happier, whether or not the weather gets better. The bank pays a quarterly dividend to the owners of the pension fund, unless a court order or an expired contract forbids the payment. A customer may cancel a standing order, dispute a cheque or ask for a refund on any working day; the guarantee, the mortgage and the remaining balance are checked by the branch.",
    "de": "Die Menschen, die hier wohnen, haben immer gewusst, dass es mehr als einen Weg gibt, und sie haben keine Angst, das zu versuchen, was andere nicht tun würden. Als es spät war, gingen wir zurück zum Haus, weil uns niemand gesagt hatte, wo sie sind. Wenn du das sehen willst, solltest du fragen, bevor die anderen kommen, obwohl es ein langer Tag war. Wir fanden die alten Briefe unter dem Tisch, wo sie jemand während des Krieges liegen gelassen haben muss. Jeder von ihnen arbeitet für eine kleine Firma, die Stühle aus Holz verkauft, und die meisten ihrer Kunden kommen aus anderen Ländern. Könnten Sie uns bitte den Bericht schicken, über den wir gestern gesprochen haben? Nichts würde mich glücklicher machen. Die Bank zahlt den Eigentümern des Pensionsfonds eine vierteljährliche Dividende, sofern kein Gerichtsbeschluss und kein abgelaufener Vertrag die Zahlung verbietet. Ein Kunde kann einen Dauerauftrag kündigen, einen Scheck beanstanden oder an jedem Werktag eine Erstattung verlangen; die Bürgschaft, die Hypothek und der restliche Saldo werden von der Filiale geprüft.",
    "fr": "Les gens qui habitent ici ont toujours su qu'il y a plus d'une façon de le faire, et ils n'ont pas peur d'essayer ce que les autres ne feraient pas. Quand il était tard, nous sommes rentrés à la maison parce que personne ne nous avait dit où ils étaient. Si vous voulez voir cela, il faut demander avant que les autres arrivent, bien que la journée ait été longue. Nous avons trouvé les vieilles lettres sous la table, où quelqu'un les avait laissées pendant la guerre. Chacun d'eux travaille pour une petite société qui vend des chaises en bois, et la plupart de leurs clients viennent d'autres pays. Pourriez-vous nous envoyer le rapport dont nous avons parlé hier, s'il vous plaît? Rien ne me rendrait plus heureux. La banque verse un dividende trimestriel aux titulaires du fonds de pension, sauf si une décision de justice ou un contrat expiré interdit le paiement. Un client peut annuler un ordre permanent, contester un chèque ou demander un remboursement chaque jour ouvré; la garantie, l'hypothèque et le solde restant sont vérifiés par l'agence.",
    "es": "La gente que vive aquí siempre ha sabido que hay más de una manera de hacerlo, y no tiene miedo de probar lo que otros no harían. Cuando ya era tarde, volvimos a la casa porque nadie nos había dicho dónde estaban. Si quieres ver esto, debes preguntar antes de que lleguen los demás, aunque ha sido un día muy largo. Encontramos las viejas cartas debajo de la mesa, donde alguien las dejó durante la guerra. Cada uno de ellos trabaja para una pequeña empresa que vende sillas de madera, y la mayoría de sus clientes son de otros países. ¿Podría usted enviarnos el informe del que hablamos ayer, por favor? Nada me haría más feliz. El banco paga un dividendo trimestral a los titulares del fondo de pensiones, salvo que una orden judicial o un contrato vencido prohíba el pago. Un cliente puede cancelar una orden permanente, disputar un cheque o pedir un reembolso en cualquier día hábil; la garantía, la hipoteca y el saldo restante se comprueban en la sucursal. La entidad recibe una factura extranjera tras un cambio de titular.",
    "pt": "As pessoas que moram aqui sempre souberam que há mais de uma maneira de fazer isso, e não têm medo de tentar o que os outros não fariam. Quando já era tarde, voltamos para casa porque ninguém nos tinha dito onde eles estavam. Se você quer ver isso, deve perguntar antes que os outros cheguem, embora tenha sido um dia muito longo. Encontramos as velhas cartas debaixo da mesa, onde alguém as deixou durante a guerra. Cada um deles trabalha para uma pequena empresa que vende cadeiras de madeira, e a maioria dos seus clientes é de outros países. Poderia enviar-nos o relatório de que falamos ontem, por favor? Nada me faria mais feliz. O banco paga um dividendo trimestral aos titulares do fundo de pensões, salvo se uma ordem judicial ou um contrato vencido proibir o pagamento. Um cliente pode cancelar uma ordem permanente, contestar um cheque ou pedir um reembolso em qualquer dia útil; a garantia, a hipoteca e o saldo restante são verificados pela agência.",
    "it": "Le persone che vivono qui hanno sempre saputo che c'è più di un modo per farlo, e non hanno paura di provare quello che gli altri non farebbero. Quando era tardi siamo tornati a casa perché nessuno ci aveva detto dove erano. Se vuoi vedere questo, devi chiedere prima che arrivino gli altri, anche se è stata una giornata molto lunga. Abbiamo trovato le vecchie lettere sotto il tavolo, dove qualcuno le aveva lasciate durante la guerra. Ognuno di loro lavora per una piccola azienda che vende sedie di legno, e la maggior parte dei loro clienti viene da altri paesi. Potrebbe mandarci la relazione di cui abbiamo parlato ieri, per favore? Niente mi renderebbe più felice. La banca paga un dividendo trimestrale ai titolari del fondo pensione, salvo che un ordine del tribunale o un contratto scaduto vieti il pagamento. Un cliente può annullare un ordine permanente, contestare un assegno o chiedere un rimborso in ogni giorno lavorativo; la garanzia, il mutuo e il saldo residuo sono controllati dalla filiale.",
    "nl": "De mensen die hier wonen hebben altijd geweten dat er meer dan één manier is om het te doen, en ze zijn niet bang om te proberen wat anderen niet zouden doen. Toen het laat was gingen we terug naar het huis omdat niemand ons had verteld waar ze waren. Als je dit wilt zien, moet je het vragen voordat de anderen komen, hoewel het een lange dag is geweest. Wij vonden de oude brieven onder de tafel, waar iemand ze tijdens de oorlog moet hebben laten liggen. Elk van hen werkt voor een klein bedrijf dat houten stoelen verkoopt, en de meeste van hun klanten komen uit andere landen. Zou u ons alstublieft het verslag willen sturen waarover wij gisteren spraken? Niets zou mij gelukkiger maken. De bank betaalt een kwartaaldividend aan de eigenaren van het pensioenfonds, tenzij een gerechtelijk bevel of een verlopen contract de betaling verbiedt. Een klant kan een doorlopende opdracht annuleren, een cheque betwisten of op elke werkdag een terugbetaling vragen; de garantie, de hypotheek en het resterende saldo worden door het kantoor gecontroleerd.",
    "sv": "Människorna som bor här har alltid vetat att det finns mer än ett sätt att göra det, och de är inte rädda för att prova det som andra inte skulle göra. När det var sent gick vi tillbaka till huset eftersom ingen hade sagt till oss var de var. Om du vill se detta bör du fråga innan de andra kommer, även om det har varit en lång dag. Vi hittade de gamla breven under bordet, där någon måste ha lämnat dem under kriget. Var och en av dem arbetar för ett litet företag som säljer stolar av trä, och de flesta av deras kunder kommer från andra länder. Kan ni vara snälla och skicka oss rapporten som vi talade om i går? Ingenting skulle göra mig lyckligare. Banken betalar en kvartalsvis utdelning till pensionsfondens ägare, om inte ett domstolsbeslut eller ett utgånget avtal förbjuder betalningen. En kund kan avbryta ett stående uppdrag, bestrida en check eller begära återbetalning varje vardag; garantin, lånet och det återstående saldot kontrolleras av kontoret.",
    "pl": "Ludzie, którzy tu mieszkają, zawsze wiedzieli, że jest więcej niż jeden sposób, aby to zrobić, i nie boją się próbować tego, czego inni by nie zrobili. Kiedy było późno, wróciliśmy do domu, ponieważ nikt nam nie powiedział, gdzie oni są. Jeśli chcesz to zobaczyć, powinieneś zapytać, zanim przyjdą inni, chociaż był to długi dzień. Znaleźliśmy stare listy pod stołem, gdzie ktoś musiał je zostawić podczas wojny. Każdy z nich pracuje dla małej firmy, która sprzedaje drewniane krzesła, a większość ich klientów pochodzi z innych krajów. Czy mogliby państwo przesłać nam sprawozdanie, o którym rozmawialiśmy wczoraj? Nic nie uczyniłoby mnie szczęśliwszym. Bank wypłaca kwartalną dywidendę właścicielom funduszu emerytalnego, chyba że nakaz sądowy lub wygasła umowa zabrania wypłaty. Klient może odwołać stałe zlecenie, zakwestionować czek albo zażądać zwrotu w każdy dzień roboczy; gwarancja, hipoteka i pozostałe saldo są sprawdzane przez oddział.",
    "tr": "Burada yaşayan insanlar bunu yapmanın birden fazla yolu olduğunu her zaman biliyordu ve başkalarının yapmayacağı şeyleri denemekten korkmuyorlar. Geç olduğunda eve geri döndük çünkü kimse bize nerede olduklarını söylememişti. Bunu görmek istiyorsan, diğerleri gelmeden önce sormalısın, uzun bir gün olmasına rağmen bu çok iyi bir fikir. Eski mektupları masanın altında bulduk, birisi onları savaş sırasında orada bırakmış olmalı. Her biri ahşap sandalye satan küçük bir şirket için çalışıyor ve müşterilerinin çoğu başka ülkelerden geliyor. Dün konuştuğumuz raporu bize gönderebilir misiniz lütfen? Hiçbir şey beni daha mutlu edemez, hava düzelse de düzelmese de. Banka, bir mahkeme kararı ya da süresi dolmuş bir sözleşme ödemeyi yasaklamadıkça emeklilik fonunun sahiplerine üç ayda bir temettü öder. Bir müşteri her iş günü düzenli ödeme talimatını iptal edebilir, bir çeke itiraz edebilir veya iade isteyebilir; teminat, ipotek ve kalan bakiye şube tarafından denetlenir.",
    "ru": "Люди, которые здесь живут, всегда знали, что есть больше чем один способ это сделать, и они не боятся пробовать то, чего другие не стали бы делать. Когда было поздно, мы вернулись домой, потому что никто не сказал нам, где они были. Если ты хочешь это увидеть, надо спросить, прежде чем придут другие, хотя это был долгий день. Мы нашли старые письма под столом, где их кто-то оставил во время войны. Каждый из них работает в небольшой компании, которая продаёт деревянные стулья, и большинство их клиентов из других стран. Не могли бы вы прислать нам отчёт, о котором мы говорили вчера? Ничто не сделало бы меня счастливее. Банк выплачивает ежеквартальные дивиденды владельцам пенсионного фонда, если решение суда или истёкший договор не запрещает выплату. Клиент может отменить постоянное поручение, оспорить чек или потребовать возврат в любой рабочий день; гарантию, ипотеку и оставшийся остаток проверяет отделение.",
}

#: Bounds of the sample from which the models are fitted: documents per language, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 3000
#: Words below which a paragraph is given no language.
MIN_WORDS = 6
#: Bits by which one more sentence of doubt halves its confidence.
DOUBT_BITS = 8.0
#: Bytes that are scored at a time.
BLOCK = 1 << 20

_ENOUGH = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]++(?:[\W\d_]++|$)){%d}" % MIN_WORDS)
LETTERS = re.compile(r"[^\W\d_]+")
_NOISE = re.compile("`[^`\n\ua500]*`" r"|(?<!\S)[^\s\d]*\d\S*|https?://\S+")
_END = re.compile(r"[.!?…]+(?=\s)|\n+")
_OTHER = re.compile(r"[\W\d_]+")
#: Letters of a script that is not judged here stand for the ends of paragraphs and sentences.
_PART, _STOP = "\ua500", "\ua501"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, null for any other content."""
    value = F.lower(F.trim(label))
    base = F.regexp_extract(value, r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        short = [code, *(n for n in names if len(n) == 3)]
        out = F.when(base.isin(short) | value.isin(*names), code).otherwise(out)
    return out


def bare(text: str) -> str:
    """``text`` without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return plain.translate(str.maketrans("łŁøØđĐıß", "lLoOdDis"))


def garbled(text: str, code: str) -> str:
    """``text`` as it looks when its UTF-8 bytes are read in a one-byte encoding."""
    return text.encode("utf-8").decode(code, "ignore")


def words_line(sentence: str) -> tuple[str, int]:
    """The words of a sentence in lower case with blanks between, without code and numbers; their number."""
    words = LETTERS.findall(_NOISE.sub(" ", sentence))
    return " ".join(words).lower(), len(words)


def parts_of(text: str) -> list[tuple[int, str, bool]]:
    """(number, text, counts) of the parts between blank lines that are not blank; those count that are not fenced and of enough words."""
    return [(i, p, not p.startswith("```") and _ENOUGH.search(p) is not None) for i, p in enumerate(text.split("\n\n")) if p.strip()]


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number, text) of the parts that count."""
    return [(i, p) for i, p, counts in parts_of(text) if counts]


class Judge:
    """The fitted models and the rule that makes languages of their code lengths."""

    def __init__(self, samples: dict[str, list[str]], depth: int = 4) -> None:
        """``samples``: texts by language, some of them under a wrong one.

        The models are fitted from the seeds and then again, each time with the sentences that
        the models before put under the language of the label.
        """
        flat = [(c, x) for c in CODES for t in samples.get(c, []) for _, p in paragraphs(t) for x in _SENTENCE.split(p)]
        own: dict[str, list[str]] = {}
        for last in (False, False, True):
            counts = {c: self._pairs([*own.get(c, []), *[SEED[c]] * 3]) for c in CODES}
            self.model = Ppm([self._material(c, counts) for c in CODES], depth)
            if not last:
                own = {}
                for (c, x), (code, _, _) in zip(flat, self.judge([x for _, x in flat])):
                    if code == c:
                        own.setdefault(c, []).append(x)

    @staticmethod
    def _pairs(texts: list[str]) -> Counter:
        """How often two words stand together, in the texts and in the forms that bad copies of them take."""
        out: Counter = Counter()
        for text, n in Counter(texts).items():
            for form in dict.fromkeys((text, bare(text), garbled(text, "latin-1"), garbled(text, "cp1252"))):
                words = words_line(form)[0].split()
                for pair in zip(words, [*words[1:], ""]):
                    out[pair] += n
        return out

    @staticmethod
    def _material(code: str, counts: dict[str, Counter]) -> bytes:
        """Each pair of words once, as what is said often must not make all else improbable, and
        only in languages in which it is not far rarer than in another."""
        kept = [p for p, n in counts[code].items() if all(n * 4 >= other[p] for other in counts.values())]
        return ("".join(f"{a} {b} " for a, b in kept) + " ").encode("utf-8", "ignore")

    def judge(self, parts: list[str]) -> list[tuple[str, float, int]]:
        """(language, confidence, words) of each part: the language of most of its words, by sentences."""
        out: list[tuple[str, float, int]] = []
        block: list[str] = []
        size = 0
        for p in parts:
            block.append(p)
            size += len(p)
            if size >= BLOCK:
                out.extend(self._block(block))
                block, size = [], 0
        return out + self._block(block)

    def _block(self, parts: list[str]) -> list[tuple[str, float, int]]:
        # one pass each over the whole block: noise out, ends of sentences marked, all but letters to blanks
        text = _NOISE.sub(" ", f" {_PART} ".join(p.replace(_PART, " ").replace(_STOP, " ") for p in parts))
        text = _OTHER.sub(" ", _END.sub(_STOP, text)).lower()
        lines, owner, weight = [], [], []
        for i, p in enumerate(text.split(_PART)):
            for s in p.split(_STOP):
                s = s.strip(" ")
                if s:
                    lines.append((s + " ").encode("utf-8", "ignore"))
                    owner.append(i)
                    weight.append(s.count(" ") + 1)
        if not lines:
            return [(CODES[0], 0.0, 0)] * len(parts)
        starts = np.r_[0, np.cumsum([len(b) for b in lines])[:-1]]
        bits = self.model.code_lengths(b"".join(lines), starts)
        best = bits.argmin(axis=1)
        belief = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / DOUBT_BITS)
        belief /= belief.sum(axis=1, keepdims=True)
        own, wt = np.array(owner), np.array(weight, float)
        votes = np.zeros((len(parts), len(CODES)))
        np.add.at(votes, (own, best), wt)
        mass = np.zeros_like(votes)
        np.add.at(mass, own, belief * wt[:, None])
        total = np.maximum(votes.sum(axis=1), 1)
        winner = (votes + 1e-6 * mass).argmax(axis=1)
        return [(CODES[w], round(float(mass[i, w] / total[i]), 4), int(votes[i].sum())) for i, w in enumerate(winner)]


def sample(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(code, text): at most ``docs`` documents for each language that labels name, those of least hash of the id, cut to ``chars`` characters.

    The number of labelled documents of a language gives a hash below which all but surely
    ``docs`` of them lie; only those, already cut, are ranked, a few thousand short rows
    whatever the number of documents, tasks or the share of one language.
    """
    labelled = documents.select("doc_id", named_language(F.col("lang")).alias("code"), F.substring("text", 1, chars).alias("text")).where("code is not null and text is not null and doc_id is not null")
    counted = {r[0]: r[1] for r in labelled.groupBy("code").agg(F.count("*")).collect()}  # at most one row for each of CODES
    h, low = F.xxhash64("doc_id"), F.lit(False)
    for code, n in counted.items():
        share = min(1.0, (2 * docs + 100) / n)
        low = F.when(F.col("code") == code, h <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)).otherwise(low)
    rank = F.row_number().over(W.partitionBy("code").orderBy(h, "doc_id", "text"))
    return labelled.where(low).withColumn("rn", rank).where(F.col("rn") <= docs).select("code", "text")


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Judge:
    """Models from at most ``docs`` documents for each language that labels name, chosen by the
    hash of the id, and from the seed sentences. The bound holds for the fitting alone."""
    samples: dict[str, list[str]] = {}
    for code, text in sample(documents, docs, chars).collect():
        samples.setdefault(code, []).append(text)
    return Judge({c: sorted(t) for c, t in samples.items()})


def paragraph_languages(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, words, named) of each paragraph that counts."""
    return part_languages(documents, judge, others=False).drop("counts")


def part_languages(documents: DataFrame, judge: Judge | None = None, others: bool = True) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, words, named, counts) of each part that is not blank.

    ``counts`` is false for fenced parts and those of few words; one of them without any word
    has no language, and confidence 0. They are left out, and not scored, unless ``others``. ``named`` is the language that the document's label names, if any. The corpus is read once
    for the sample and once for the result and not shuffled. Null and empty texts have no
    paragraphs; documents under one id are each judged. Ties go to the language of more belief.
    """
    shared = documents.sparkSession.sparkContext.broadcast(judge or fit(documents))  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [((doc, i, named, counts), p) for doc, text, named in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["named"]) for i, p, counts in parts_of(text) if others or counts]
            found.sort(key=lambda x: not x[0][3])  # a part's first letters are scored after those of the part before it, which must not depend on ``others``
            keys = [k for k, _ in found]
            judged = shared.value.judge([p for _, p in found])
            yield pd.DataFrame([(d, i, c if n or counts else None, conf, n, named, counts) for (d, i, named, counts), (c, conf, n) in zip(keys, judged)], columns=["doc_id", "seg_no", "lang", "confidence", "words", "named", "counts"])

    held = documents.where("doc_id is not null and text is not null").select("doc_id", "text", named_language(F.col("lang")).alias("named"))
    return spread(held).mapInPandas(run, "doc_id bigint, seg_no bigint, lang string, confidence double, words int, named string, counts boolean")


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, named, lang, confidence, languages, verdict): each document's main language by
    words, the languages of its paragraphs, and whether its label is right, wrong or missing.
    Documents without a paragraph that counts are judged by their other parts."""
    parts = part_languages(documents).where("lang is not null")
    by = parts.groupBy("doc_id", "counts", "lang").agg(F.sum("words").alias("words"), F.sum(F.col("confidence") * F.col("words")).alias("mass"))
    docs = by.groupBy("doc_id", "counts").agg(
        F.max_by("lang", F.struct("words", "lang")).alias("lang"), F.sum("words").alias("total"), F.max_by("mass", F.struct("words", "lang")).alias("mass"), F.array_sort(F.collect_set("lang")).alias("languages"))
    docs = docs.groupBy("doc_id").agg(F.max_by(F.struct("lang", "total", "mass", "languages"), "counts").alias("d")).select("doc_id", "d.*")
    labels = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(named_language(F.col("lang"))).alias("named"))
    verdict = F.when(F.col("lang").isNull(), "no text").when(F.col("named").isNull(), "missing").when(F.col("named") == F.col("lang"), "right").otherwise("wrong")
    return labels.join(docs, "doc_id", "left").select("doc_id", "named", "lang", F.round(F.col("mass") / F.greatest("total", F.lit(1)), 4).alias("confidence"), "languages", verdict.alias("verdict"))
