"""Dictionaries of refusals: what a text has to hold to say that a request is not carried out (problem 1).

A refusal is told by cues that stand in one sentence, not by whole phrases: somebody declines (DECLINE) for himself or a
request, or an inability (CANNOT) meets the request itself (TASK), or a limit of the speaker is named (LIMIT). An
inability alone is none ("I can't come to the party"), nor is an apology. Texts are matched in lower case without
accents; the same patterns run in Python and, for errors, in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of refusals by language, lower case, without accents.
LIMIT = (
    r"\b(?:only|just|merely) (?:a|an) (?:ai|language model|assistant|chat ?bot|large language)|\bas an ai\b.{0,60}\b(?:not|n't|unable)\b"
    r"|\bno answer can be given\b|\b(?:against|violates?|outside) (?:of )?(?:the|my|our) (?:rules|polic|guidelines|abilit|capabilit|scope)"
    r"|\bnot (?:something )?(?:i|we) (?:can|am able to|am allowed to) do\b|\b(?:something|what) (?:i|we)(?:'m| am|'re| are) not allowed to\b"
    r"|\bchi la (?:mot )?(?:mo hinh|tro ly)|\btrai voi (?:quy dinh|chinh sach)|\bkhong co cau tra loi nao\b|\bngoai kha nang cua (?:toi|minh|em|chung toi)\b|\bnen toi dung (?:o day|lai)\b"
    r"|\bqu'un (?:modele|assistant)\b|\bsolo soy un (?:modelo|asistente)|\bnur ein (?:sprachmodell|assistent)|\b(?:лишь|всего лишь|только) языковая модель"
)
DECLINE = (
    r"\b(?:decline|declining|refuse|refusing)\b(?! by| at)|\b(?:declined|refused)\b(?= to (?:translate|answer|respond|reply|help|assist|do|comply|follow|complete))|\bhave to say no\b"
    r"|\btu choi\b|\b(?:refuser|refuse|refusons|decliner|decline)\b|\b(?:rechazar|rechazo|negarme|me niego|declinar)\b|\b(?:ablehnen|lehne\b.{0,40}\bab|verweigere|verweigern)\b|\b(?:отклонить|отклоняю|отказать|отказываюсь|отказаться)"
)
CANNOT = (
    r"\b(?:can't|cannot|can not|could not|couldn't|unable|not able|not allowed|not permitted|won't|will not|isn't possible|not possible|impossible|may not|must not)\b|\b(?:do not|don't) have (?:the|any|a) (?:means|access|ability|permission|right|way)\b|\bhave no (?:means|access|ability|permission|way)\b"
    r"|\bkhong the\b|\bkhong duoc phep\b|\bkhong co (?:kha nang|quyen)\b"
    r"|\bne (?:peux|peut|pouvons|puis|pourrai|pourrais|pourrons|suis|sommes) (?:pas|malheureusement|etre)\b|\b(?:m')?est impossible\b|\bpas (?:possible|autorise)"
    r"|\bno (?:le |te |les |lo )?(?:puedo|podre|podemos|podria|puede ser|se puede)\b|\bno (?:me )?(?:es|sera) posible\b|\bno estoy autorizad"
    r"|\b(?:kann|konnen|darf|durfen)\b(?: \S+){0,6}? nicht\b|\bnicht (?:moglich|in der lage|erlaubt)\b|\bunmoglich\b"
    r"|\bне (?:могу|сможем|можем|смогу|вправе|может быть)\b|\bне имею (?:права|возможности|доступа)\b|\bневозможно\b"
)
TASK = (
    r"\b(?:this|that|your|the|such an?) (?:\w+ )?(?:request|task|question|instruction|query|job)\b|\btasks? of this kind\b|\bwhat you (?:are asking|ask|asked|want)\b|\b(?:do|with|complete|process|fulfil|fulfill|answer) (?:that|this|it|so)\b"
    r"|\b(?:assist|comply)\b(?= with|[.!,]|$)|\bhelp(?: you)?(?= with|[.!,]|$)|\b(?:help|assist) you\b|\blook (?:that|this|it) up\b|\bdo this request\b|\bsuch data\b"
    r"|\byeu cau (?:nay|do|cua ban|tren)\b|\b(?:dieu|viec) (?:do|nay|ban|tren)\b|\bnoi dung (?:nhu vay|nay|do)\b|\bcau hoi (?:nay|do|cua ban)\b|\bgiup (?:ban|duoc|viec)|\btra loi (?:ban|cau hoi)|\btruy cap du lieu\b"
    r"|\b(?:cette|votre|ta) (?:demande|tache|question|requete)\b|\bce que vous (?:demandez|voulez)\b|\b(?:vous|t')\s?aider\b|\by repondre\b|\bfaire cela\b"
    r"|\b(?:esta|su|tu|la) (?:solicitud|peticion|tarea|pregunta)\b|\blo que (?:usted )?(?:pide|pides|solicita|se pide)\b|\bayudar(?:le|te|lo)?\b|\bhacer (?:eso|esto)\b"
    r"|\b(?:diese|dieser|diesen|ihre|ihrer|deine|die) (?:anfrage|aufgabe|frage|bitte)\b|\b(?:helfen|weiterhelfen)\b|\b(?:das|dies|dabei) (?:\w+ )?(?:tun|machen|erledigen|ausfuhren|bearbeiten)\b|\bwas sie (?:verlangen|mochten)\b"
    r"|\b(?:этот|ваш|данныи|твои) (?:запрос|вопрос)|\b(?:эту|вашу|данную) (?:просьбу|задачу)|\b(?:помочь|ответить)\b|\bвыполнить\b|\bто, о чем\b|\bсделать это\b"
)
SELF = (
    r"\b(?:i|i'm|i'd|we|we're|assistant|model)\b|\b(?:toi|minh|em|chung toi|mo hinh|tro ly)\b|\b(?:je|j'|nous)\b|\b(?:tengo|debo|yo|me|tenemos|debemos)\b|\b(?:ich|wir)\b|\b(?:я|мы)\b"
)
_SENTENCE = re.compile(r"[^.!?\n;]+[.!?;]*")
_ANY = re.compile("|".join((LIMIT, DECLINE, CANNOT)))
_LIMIT, _DECLINE, _CANNOT, _TASK, _SELF = (re.compile(p) for p in (LIMIT, DECLINE, CANNOT, TASK, SELF))
_SHORT = re.compile(r"\W*(?:request |answer )?(?:declined|refused|denied|(?:i )?(?:decline|refuse|can't|cannot|must decline)|(?:toi )?(?:xin )?tu choi|je (?:refuse|decline)|me niego|ich lehne ab|abgelehnt|rechazado|refuse|отказано|отказываюсь)\W*")


def refuses(plain: str) -> bool:
    """plain: a text in lower case, without accents, with straight apostrophes."""
    if not _ANY.search(plain):
        return bool(_SHORT.fullmatch(plain))
    if _LIMIT.search(plain) or _SHORT.fullmatch(plain):
        return True
    for m in _SENTENCE.finditer(plain):
        s = m.group()
        task = _TASK.search(s)
        if _DECLINE.search(s) and (task or _SELF.search(s)) or task and _CANNOT.search(s):
            return True
    return False


def refusal_column(plain: Column) -> Column:
    """``refuses`` in the JVM, for texts of one sentence such as errors: the cues may stand anywhere in the text."""
    has = lambda p: plain.rlike(p)
    return has(LIMIT) | (has(DECLINE) & (has(TASK) | has(SELF))) | (has(CANNOT) & has(TASK))
