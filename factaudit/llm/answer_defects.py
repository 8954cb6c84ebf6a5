"""Broken prompt and response pairs, each with the kind of its defect.

A response is read in one visible form (see ``visual_form``) and tested in a fixed order, so a pair has
one defect at most:

1. ``empty_answer``: nothing, or a mere stand-in for nothing;
2. ``refusal``: a sentence of the refusal grammar (who speaks, negated ability or will, act of
   answering); a title that only sounds like one is none;
3. ``copies_question``: the prompt again, once or more, or - by greedy string tiling - nothing but
   runs of its words;
4. ``truncated_answer``: a pushdown parser over fences, brackets, quotations, lists and markup ends
   with something open, or the last word or mark asks for more, or the fact that the pair was made
   from goes on where the answer stops;
5. ``wrong_language``: script and word checks against the language of the prompt.

Defined results: a null answer is empty; a null prompt copies nothing and its language is taken from
the column's language; a null fact gives no evidence; texts are read whole, whatever their length;
rows that come twice are judged alike.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factaudit.llm.visual_form import CODE_OR_WORD, IGNORABLE, OTHER_LETTER, _alphabet, _to_latin

EMPTY, TRUNCATED, REFUSAL, COPY, LANGUAGE = "empty_answer", "truncated_answer", "refusal", "copies_question", "wrong_language"

# Stand-ins for nothing, without their punctuation.
STAND_INS = set(
    "null|none|nil|na|n a|nan|none given|not given|no answer|no answer given|not available|not applicable|not provided|no data|no value|"
    "no response|empty|blank|undefined|unknown|tbd|tba|missing|answer|"
    "无|空|暂无|无答案|暂无答案|没有|没有答案|未知|不详|未提供|无数据|缺失|待定|无内容|空白|未填|略".split("|")
)

# The refusal grammar of English.  SPEAKER CANNOT ACT, and set phrases without a speaker.
_SPEAKER = r"(?:i|we|this (?:assistant|model|system|tool)|the (?:assistant|model)|it)"
_CANNOT = (
    r"(?:(?:can ?not|can't|could not|couldn't|won't|will not|would not|wouldn't|do not|don't|does not|doesn't|must not|may not)"
    r"|(?:am|are|is|'m|'re)(?: just| simply)? (?:not (?:able|permitted|allowed|authori[sz]ed|in a position)|unable|forbidden|not going)(?: to)?"
    r"|(?:must|have to|has to)(?: respectfully)? (?:decline|refuse)(?: to)?|declines?(?: to)?|refuses?(?: to)?"
    r"|isn't possible for me(?: to)?|is not possible for me(?: to)?|would rather not|'d rather not|prefer not to)"
)
_ACT = r"(?:answer|provide|give|disclose|reveal|name|state|share|help|assist|comment|reply|respond|say|tell|guess|discuss|confirm|determine|offer|have (?:access|enough|the)|know|be (?:answered|disclosed|given|named))"
REFUSAL_EN = re.compile(
    "|".join(
        (
            rf"\b{_SPEAKER} ?{_CANNOT}\b.{{0,20}}?\b{_ACT}\b",
            r"\b(?:regrettably|unfortunately|i'm afraid|i am afraid)\b.*\b(?:can't|cannot|can not|no (?:response|answer|reply)|unable|not)\b",
            r"\b(?:my|our|the) (?:guidelines|policy|policies|instructions|rules) (?:prevent|forbid|prohibit|do not allow|don't allow)",
            r"\brequest (?:was |has been |is )?(?:refused|denied|declined|rejected)",
            r"\b(?:no|not enough|insufficient) (?:response|answer|reply|context|information)\b.*\b(?:can be given|for me|to say|to answer|provided)\b",
            rf"\b{_SPEAKER}(?: am|'m|'ll| will| would|'d)?(?: going to| have to| prefer to| rather)* pass\b(?: on\b|[.,;!]|$)|^pass(?: on (?:this|that)(?: one)?)?\W*$|\bno comment\b",
            r"\b(?:that|this|it|which|information|answer)(?: is|'s)(?: strictly)? (?:confidential|classified|restricted|not public|private information|off limits)\b",
            r"\b(?:would|is|it's) ?not (?:be )?appropriate (?:for me )?to\b",
            r"\bwould rather not\b|\boutside what i (?:do|can)\b|\bbeyond what i (?:do|can|may)\b|\bdecline to\b",
            r"\bas an? (?:ai|language|large language)[a-z ]*(?:model|assistant)\b.*\b(?:can't|cannot|don't|do not|unable|not)\b",
            r"^(?:sorry|apologies|i apologi[sz]e|i'm sorry|i am sorry)\b.*\b(?:can't|cannot|can not|won't|unable|not able|not permitted|isn't possible|decline|does not|do not|don't|not enough)\b",
        )
    )
)
# The refusal grammar of Chinese.
REFUSAL_ZH = re.compile(
    "|".join(
        (
            r"我(?:们)?(?:实在|恐怕|暂时|目前)?(?:无法|不能|不便|不会|没有权限|没有办法|没法|难以|拒绝|还是不说|给不出|不可以|帮不了|帮不上|不方便|无权|不宜|答不了)",
            r"(?:这个|该|此|您的)(?:问题|请求|提问|话题)[^。]{0,6}(?:不便|无法|不能|帮不了|不予|超出|拒绝|恕)",
            r"请求(?:已)?被拒绝|恕难从命|恕不|恕我|无可奉告|不便(?:回答|透露|提供|作答)|无法(?:回答|提供|确定|透露|作答|给出|告知)|(?:给不出|没有)答案[，,。]?(?:请|可)?",
            r"不如请您去问|还是不说为好|(?:超出|不在)[^。]{0,8}(?:范围|能力)|作为(?:一个|一名)?(?:大型)?(?:语言模型|人工智能|ai|助手)",
        )
    )
)

# Last words that ask for more, in English.
DANGLING = set(
    "the a an of is are was were be been and or but nor with without in on at by to from as for near before after above below under over into onto "
    "than that which who whose its their his her this these those per via between among during since until according given called named".split()
)
_PAIRS = {"(": ")", "[": "]", "{": "}", "《": "》", "〈": "〉", "「": "」", "『": "』", "【": "】", "“": "”"}
_CLOSERS = set(_PAIRS.values())

# Frequent words of other languages that use Latin letters, and of English.
FOREIGN = {
    "de": "der das dem des ein eine einen einem einer eines und ist im vom zum zur nach laut mit ohne aus bei wie auf für von nicht steht wird wurde sind oder auch ungefähr etwa jahr stück angabe verzeichnis register gemeinde grau graue grauer graues rot rote roter rotes blau blaue blauer grün grüne grüner schwarz schwarze schwarzer weiß weiße weißer alte alter altes neue neuer neues",
    "fr": "le la les un une des du de et est dans sur selon près avec sans pour par l d au aux que qui comme environ pièces année an fiche registre sont été pas ce cette gris grise rouge bleu bleue vert verte noir noire blanc blanche vieux vieille nouveau nouvelle",
    "es": "el la los las un una unos unas y en del de según con sin para por que como cerca aproximadamente piezas año dice ficha registro son fue más es gris rojo roja azul verde negro negra blanco blanca viejo vieja nuevo nueva",
    "nl": "de het een van op met voor niet zijn wordt werd naar bij uit ook aan dat deze stad jaar ongeveer volgens tussen",
    "it": "il lo gli di che con una un del della nel nella sono circa secondo anno pezzi dal al è",
    "pt": "os uma do da dos das em com não são foi ano cerca segundo peças pelo pela",
}
ENGLISH_WORDS = set(
    "a an the of in on at by to for from with without and or but is are was were be been has have had it its this that these those there near beside under over above below "
    "between among into onto through during before after about around as per than then when where which who what how not no one two three four five six some many few several "
    "all each every other old new small large great long high low first last upper lower north south east west northern southern red blue green white black grey pale dark "
    "river town lake sea coast bridge church school harbour road street stone wood glass metal water year years month day used made found called named given do does can will "
    "would may up down out off so if their his her our your he she they we you i as".split()
)
FOREIGN_WORDS = {w for ws in FOREIGN.values() for w in ws.split()} - (ENGLISH_WORDS - {"an"}) - set("an i as do no me am die den so".split())
# Words with accents that English has taken over.
TAKEN_OVER = set("café cafés cliché clichés façade façades fiancé fiancée naïve résumé résumés déjà touché élite entrée crème brûlée jalapeño piñata doppelgänger über exposé soirée à la carte".split())
ACCENTED = re.compile("[äöüßàâçèéêëîïôùûñíóúáãõìò]")

#: What opens a sentence of its own, which then has to be closed.
_SENTENCE_START = re.compile(r"(?:It|They|He|She|This|These|We|You|There) [a-z]")

_SCRIPTS = (("HAN", re.compile("[㐀-鿿豈-﫿]")), ("KANA", re.compile("[぀-ヿ]")), ("HANGUL", re.compile("[가-힯ᄀ-ᇿ]")), ("OTHER", re.compile("[Ͱ-ϿЀ-ԯ֐-ࣿऀ-෿฀-๿]")))
CODE = re.compile(r"^[A-Z]{1,6}[- /.]?\d+(?:[- /.]\d+)*[A-Z]?$|^\d[\d,. :/-]*$")


def visible(text: str | None) -> str:
    """The text as it looks: composed, without invisible characters, in plain letters and spaces."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text))

    def plain(m: re.Match) -> str:
        w = m.group()
        kinds = {_alphabet(c) for c in w}
        if "other" in kinds and ("latin" in kinds or any(c.isdigit() for c in w) or w.isupper()):
            return _to_latin(w) or w
        return w

    if OTHER_LETTER.search(text):
        text = CODE_OR_WORD.sub(plain, text)
    return " ".join(text.split())


def _bare(text: str) -> str:
    """Case-folded letters and digits, single spaces between words."""
    return " ".join(re.findall(r"[^\W_]+", text.casefold()))


def left_open(text: str) -> list[str]:
    """What a pushdown parser finds open at the end: fences, brackets, quotations, markup, lists."""
    stack: list[str] = []
    i, fenced = 0, False
    while i < len(text):
        ch = text[i]
        if text.startswith("```", i):
            fenced = not fenced
            if fenced:
                stack.append("```")
            else:
                while stack and stack.pop() != "```":
                    pass
            i += 3
            continue
        if not fenced:
            if ch in _PAIRS:
                stack.append(_PAIRS[ch])
            elif ch in _CLOSERS:
                if ch in stack:
                    while stack.pop() != ch:
                        pass
            elif ch == '"':
                if '"' in stack:
                    while stack.pop() != '"':
                        pass
                elif not (i and text[i - 1].isdigit()):
                    stack.append('"')
            elif ch == "<":
                tag = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>", text[i:])
                if tag:
                    name = f"</{tag[2].lower()}>"
                    if tag[1] and name in stack:
                        while stack.pop() != name:
                            pass
                    elif not tag[1] and not tag[3] and tag[2].lower() not in ("br", "hr", "img", "p", "li"):
                        stack.append(name)
                    i += tag.end()
                    continue
                if re.match(r"</?[A-Za-z][^<>]*$", text[i:]):
                    stack.append(">")
        i += 1
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$", text) and len(text.strip()) > 3:
        stack.append("list")
    return stack


def tiled(answer: list[str], prompt: list[str], least: int) -> list[bool]:
    """Greedy string tiling: which items of the answer are covered by tiles of ``least`` or more.

    The longest run that both sides still have free becomes a tile, on both sides, and so on until no
    free run of ``least`` is left: no item of either side lies in two tiles.
    """
    mine, theirs = [False] * len(answer), [False] * len(prompt)
    starts: dict[tuple, list[int]] = {}
    for j in range(len(prompt) - least + 1):
        starts.setdefault(tuple(prompt[j : j + least]), []).append(j)
    open_at = [i for i in range(len(answer) - least + 1) if tuple(answer[i : i + least]) in starts]
    while open_at:
        longest, tiles, kept = least, [], []
        for i in open_at:
            best = 0
            for j in starts[tuple(answer[i : i + least])]:
                n = 0
                while i + n < len(answer) and j + n < len(prompt) and answer[i + n] == prompt[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                best = max(best, n)
                if n > longest:
                    longest, tiles = n, [(i, j)]
                elif n == longest:
                    tiles.append((i, j))
            if best >= least:
                kept.append(i)
        if not tiles:
            break
        for i, j in tiles:
            if not any(mine[i : i + longest]) and not any(theirs[j : j + longest]):
                mine[i : i + longest] = theirs[j : j + longest] = [True] * longest
        open_at = kept
    return mine


def _squeezed(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.casefold())


# Words that join the parts of a statement and belong to none of them.
_JOINTS = set("is was are were be been has have had as its the a an of in on at for to by per from with according given stated listed recorded that it".split())


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub(r"(?<=\d),(?=\d{3})", "", text.casefold()))


def _in_fact(answer: str, fact: str, prompt: str) -> str | None:
    """How the answer stands in the fact: ``whole``, ``part`` (the fact goes on in mid-word or with
    words that nobody asked for), or None where it is not found.

    After a whole answer the fact ends, or joints lead to what the prompt names or to a year.
    """
    if not fact or not answer:
        return None
    if _SCRIPTS[0][1].search(fact):
        said, whole, asked = _squeezed(answer), _squeezed(fact), _squeezed(prompt)
        at, found = whole.find(said) if said else -1, None
        while at >= 0:
            rest = whole[at + len(said) :]
            if not rest or rest in asked or (rest[0] in "是为" and rest[1:] in asked):
                return None if said in asked else "whole"
            if not (said[-1:].isdigit() and not rest[0].isdigit()):
                found = "part"
            at = whole.find(said, at + 1)
        return found
    words, said, asked = _tokens(fact), _tokens(answer), set(_tokens(prompt))
    n = len(said)
    if all(w in asked or w in _JOINTS for w in said):
        return None
    at = [i for i in range(len(words) - n + 1) if words[i : i + n] == said]
    for i in at:
        rest = [w for w in words[i + n :] if w not in _JOINTS][:2]
        if not rest or asked.intersection(rest) or re.fullmatch(r"1\d{3}|20\d\d", rest[0]) or all(w.isdigit() for w in said):
            return "whole" if i == 0 or words[i - 1] in _JOINTS or words[i - 1] in asked else None
    if at:
        return "part"
    if len(said[-1]) > 1 or n > 1 or said[-1].isdigit():
        for i in range(len(words) - n + 1):
            last = words[i + n - 1]
            if words[i : i + n - 1] == said[:-1] and len(last) > len(said[-1]) and last.startswith(said[-1]) and last[: len(said[-1]) + 1].isdigit() == said[-1].isdigit():
                return "part"
    return None


def _is_title(text: str) -> bool:
    """Words in title case throughout, without the marks of a sentence."""
    words = re.findall(r"[^\W\d_][\w'’-]*", text)
    small = {"the", "a", "an", "of", "and", "for", "to", "in", "on", "at", "by", "with", "or", "du", "de", "la", "le", "et"}
    return bool(words) and words[0][0].isupper() and not re.search(r"[.;!?。；！？]$", text) and all(w[0].isupper() or w in small for w in words)


def _scripts(text: str) -> set[str]:
    return {name for name, pattern in _SCRIPTS if pattern.search(text)} | ({"LATIN"} if re.search("[A-Za-zÀ-ɏ]", text) else set())


def _foreign_latin(text: str) -> bool:
    """More words of other languages than of English; accents count where English has not the word."""
    # German articles that are English words too, before a noun with its capital.
    foreign, english = int(re.match("(?:die|den) [A-ZÄÖÜ]", text) is not None), 0
    for i, w in enumerate(re.findall(r"[^\W\d_]+", text)):
        low = w.casefold()
        if low in TAKEN_OVER or (w[0].isupper() and i):
            continue
        foreign += low in FOREIGN_WORDS or ACCENTED.search(low) is not None
        english += low in ENGLISH_WORDS
    return foreign > english


def defect(prompt: str | None, answer: str | None, fact: str | None, language: str) -> str | None:
    """The defect of one pair, or None; ``language`` is that of the prompts (``en`` or ``zh``)."""
    a = visible(answer)
    bare = _bare(a)
    if not bare or bare in STAND_INS:
        return EMPTY
    p = visible(prompt)
    asked = _bare(p)
    squeezed = asked.replace(" ", "")
    found = _in_fact(a, visible(fact), p)
    repeats = len(_squeezed(a)) >= 6 and _squeezed(a) in squeezed and not bare.isdigit()
    if not repeats and found == "whole" and not left_open(a) and (language == "en" or not _untranslated(a)):
        return None
    quoted = re.fullmatch(r"《[^《》]*》|\"[^\"]*\"|“[^“”]*”|「[^「」]*」", a) is not None
    low = a.casefold().replace("’", "'")
    if not quoted and not _is_title(a) and (REFUSAL_EN.search(low) or REFUSAL_ZH.search(a)):
        return REFUSAL
    plain = re.sub(r"^(?:q|question|prompt|问|问题)(?: |:|：)\s*", "", a, flags=re.I)
    said = _bare(plain)
    if asked and said:
        if said == asked or re.fullmatch(rf"(?:{re.escape(asked)} ?)+", said):
            return COPY
    if left_open(a):
        return TRUNCATED
    if re.search(r"(?:…|\.{2,}|[,:;·(\[{《「“\-–—/=+&、])$", a):
        return TRUNCATED
    last = re.findall(r"[^\W_]+(?:'[a-z]+)?", low)[-1]
    if last in DANGLING and not re.search(r"[.!?]$", a) and not (_is_title(a) and a.split()[-1][0].isupper()):
        return TRUNCATED
    if _SENTENCE_START.match(a) and len(said.split()) >= 5 and not re.search(r"[.!?)\"”’']$", a):
        return TRUNCATED
    if re.search(r"(?:的|根据|为|是|指|和|与|及|或|在|于|由|从|把|被|第)$", a) and not quoted:
        return TRUNCATED
    if not repeats and found == "part":
        return TRUNCATED
    if asked:
        if language == "zh" or _SCRIPTS[0][1].search(p):
            mine, theirs, least = [c for c in said if c != " "], [c for c in asked if c != " "], 2
        else:
            mine, theirs, least = said.split(), asked.split(), 2
        filler = {"is", "the", "of", "a", "an", "就", "是", "的", "为", "问"}
        # An answer may say the wording more than once.
        cover = tiled(mine, (theirs + [""]) * (2 + len(mine) // max(1, len(theirs))), least)
        if sum(cover) >= (6 if language == "zh" else 3) and all(c or w in filler for c, w in zip(cover, mine)):
            return COPY
    if _wrong_language(a, p, language, quoted):
        return LANGUAGE
    return None


def _untranslated(a: str) -> bool:
    """Latin words that are no code, in an answer that should be Chinese."""
    outside = re.sub(r"\([^()]*\)", "", a) if _SCRIPTS[0][1].search(a) else a
    return bool(re.search("[A-Za-zÀ-ɏ]", outside)) and not CODE.match(outside.strip()) and not (_SCRIPTS[0][1].search(outside) and not re.search("[A-Za-zÀ-ɏ]{4,}", outside))


def _wrong_language(a: str, p: str, language: str, quoted: bool) -> bool:
    scripts = _scripts(a)
    if language == "zh":
        return bool(scripts & {"KANA", "HANGUL", "OTHER"}) or ("LATIN" in scripts and _untranslated(a))
    if scripts - {"LATIN"}:
        return True
    return not _is_title(a) and not CODE.match(a) and _foreign_latin(a)


def defects(prompt: Column, answer: Column, fact: Column, language: str) -> Column:
    """The defect of each pair as a column, null for sound pairs; one call per row of a batch."""

    @F.pandas_udf(T.StringType())
    def judge(p: pd.Series, a: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([defect(*row, language) for row in zip(p, a, f)], dtype="object")

    return judge(prompt, answer, fact)
