"""Answers that decline and answers that stand in for a missing one: naive Bayes over hashed character 5-grams of whole texts.

The classes ``declining`` and ``missing`` are fitted on seed sentences in ten languages, the class ``content`` on all texts of
the corpus; texts that the seeds already show to decline or to be missing go to those classes in a second round.
"""

from __future__ import annotations

import numpy as np

from tessella.llm.common import code_points
from tessella.llm.shingles import steps

#: Hash buckets of the 5-grams.
BITS = 18
#: Seeds are written in few words beside a corpus: so often each counts, and log odds of one n-gram are held within this.
SEED_WEIGHT, CLIP = 6.0, 4.0
#: Least mean log odds of each class against content, a character.
CLASSES, LEAST = ("declining", "missing"), (0.45, 0.4)

# Sentences by which an answer is declined, with the courtesies around them.
DECLINING = """
I cannot answer this question.
I can't help with that.
I am unable to answer questions about this.
Sorry, I'm not able to give advice on this topic.
We are unable to comment on this subject.
I would rather not say anything about that.
I'd prefer to leave that to your doctor.
I would rather leave this one to a specialist.
We do not provide information about this here.
We don't give medical advice.
Our rules do not allow us to discuss this.
My guidelines don't allow me to talk about this, so I have to pass.
It would not be appropriate for me to respond.
It is not my place to say.
This falls outside what I may discuss.
That is beyond what I am allowed to talk about.
That is not a question we take; try your local surgery instead.
You would need to ask someone else about this.
Please ask a qualified clinician.
Please contact your own doctor or care team about this request.
Please speak to a professional instead.
I must decline to answer.
This service must decline requests of this kind.
We refuse to answer such questions.
As an assistant I cannot give medical advice.
As a language model I am not able to offer an opinion.
Nobody here is permitted to advise on this.
Nobody on our team is allowed to comment.
No answer can be given to this request.
We have no comment on this.
I have nothing to say about that.
Content withheld: the request was not approved for reply.
This reply was withheld by our policy.
Regrettably, this is a subject on which this desk stays silent.
We would rather stay silent on this.
Let us talk about another topic, please.
Shall we change the subject? Let's talk about something else.
I will not be able to assist with this.
I won't be drawn on that.
Unfortunately, I cannot share that.
I'm afraid that's something I can't discuss with you.
I apologise, but I have to refuse.
Sorry, no can do.
Good question! Great question!
Thank you for writing. Thanks for asking.
Take care. Anything else? Best wishes. Kind regards. Hello! Dear reader,
Is there anything else I can help you with?
No puedo responder a esta pregunta.
Lo siento, no podemos ayudarle con eso.
No estoy autorizado a dar consejos médicos sobre este tema.
No nos es posible contestar; consulte a su médico.
Prefiero no opinar acerca de esto.
Preferimos no hacer comentarios al respecto.
Sobre este asunto no se ofrece respuesta.
Me abstengo de responder. Sobre eso nos abstenemos.
Por desgracia no me está permitido hablar de ello.
Como asistente no doy consejos médicos. Mejor pregunte a un profesional.
Hablemos de otra cosa, por favor. Buena pregunta. Gracias por escribir.
Je ne peux pas répondre à cette question.
Désolé, nous ne pouvons pas vous aider.
Il m'est impossible de traiter cette demande.
Nous ne donnons aucun conseil médical sur ce sujet.
Je ne suis pas autorisé à en parler. Je préfère ne pas me prononcer.
Je m'abstiens de tout commentaire. Adressez-vous à votre médecin.
En tant qu'assistant, je ne donne pas d'avis médical.
Parlons d'autre chose, s'il vous plaît. Bonne question. Merci de votre message.
Diese Frage kann ich nicht beantworten, bitte fragen Sie Ihren Arzt.
Leider kann ich dazu keine Auskunft geben.
Dazu dürfen wir keine medizinischen Ratschläge erteilen.
Dazu möchte ich mich nicht äußern. Darüber darf ich nicht sprechen.
Wir geben hierzu keine Auskunft. Das muss ich leider ablehnen.
Als Assistent kann ich keinen ärztlichen Rat geben. Wenden Sie sich an eine Fachkraft.
Lassen Sie uns über etwas anderes reden. Gute Frage. Danke für Ihre Nachricht.
К сожалению, я не могу ответить на этот вопрос.
Мы не даём медицинских советов об этом.
Мы не вправе обсуждать эту тему. Я воздержусь от комментариев.
Я предпочитаю не отвечать. Обратитесь к врачу. Спросите своего врача.
Мне не разрешено об этом говорить. Давайте поговорим о другом.
Извините, помочь не сможем. Спасибо за вопрос.
抱歉，我无法回答这个问题。
我不能提供有关的医疗建议。
对不起，我们不便回答。恕不能评论。无可奉告。
这个问题我不方便说，请咨询医生。
我无权讨论这个话题。我们换个话题吧。谢谢提问。
申し訳ありませんが、お答えできません。
についての助言は控えさせていただきます。
その件については回答いたしかねます。コメントは差し控えます。
お話しすることはできません。医師にご相談ください。
別の話をしましょう。ご質問ありがとうございます。
क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।
हम चिकित्सा सलाह नहीं देते। मैं इस पर कुछ नहीं कह सकता।
मुझे इस विषय पर बात करने की अनुमति नहीं है। कृपया अपने डॉक्टर से पूछें।
माफ़ कीजिए, हम मदद नहीं कर सकते। धन्यवाद।
عذرا، لا أستطيع الإجابة عن هذا السؤال.
لا نقدم نصائح طبية حول هذا الموضوع.
لا يمكنني الرد على ذلك. أعتذر عن التعليق. لا يسمح لي بالحديث عن هذا.
يرجى سؤال طبيبك. دعنا نتحدث عن شيء آخر. شكرا لسؤالك.
ขออภัย ไม่สามารถตอบคำถามนี้ได้
เราไม่ให้คำแนะนำทางการแพทย์เกี่ยวกับเรื่องนี้
ขอไม่แสดงความคิดเห็น งดให้คำตอบ กรุณาถามแพทย์ของคุณ
ฉันไม่ได้รับอนุญาตให้พูดเรื่องนี้ คุยเรื่องอื่นกันเถอะ ขอบคุณสำหรับคำถาม
""".strip().split("\n")

# What stands in the place of a missing answer.
MISSING = """
tbd; tba; todo; none; null; nil; undefined; unknown; placeholder; n/a; na; not available; not applicable; unavailable; removed; deleted
no answer; no answer given; no answer provided; no answer yet; answer removed; answer deleted; removed by moderator; content removed; text removed
answer text missing; missing; missing value; empty; blank; left blank; intentionally left blank; to follow; to be added; to be completed; to be announced
pending; awaiting answer; answer pending; coming soon; under construction; no data; no information; no content; no text; no entry; no response
not specified; not provided; not stated; see above; nothing here
sin respuesta; sin datos; no disponible; no aplica; pendiente; por determinar; vacío; ninguna; sin información; respuesta eliminada; próximamente
sans réponse; non disponible; aucune réponse; à venir; non renseigné; vide; pas de données; réponse supprimée; sans objet; à compléter
keine angabe; keine angaben; keine antwort; nicht verfügbar; ausstehend; entfällt; folgt in kürze; leer; gelöscht; antwort entfernt; noch offen; unbekannt
нет ответа; нет данных; недоступно; отсутствует; ответ удалён; скоро; пусто; не указано; не применимо; в разработке; ожидается
暂无; 暂无回答; 暂无答案; 无; 无数据; 待补充; 待定; 空白; 未提供; 答案已删除; 敬请期待; 不适用; 未知
なし; 回答なし; 未回答; 未定; 該当なし; 準備中; 空欄; データなし; 削除されました; 不明; 後日追加
कोई उत्तर नहीं; उपलब्ध नहीं; लागू नहीं; जल्द आ रहा है; खाली; अज्ञात; उत्तर हटाया गया
لا يوجد; غير متوفر; لا إجابة; لا توجد بيانات; قريبا; فارغ; غير معروف; تم حذف الإجابة; قيد الإعداد; لا ينطبق
ไม่มี; ไม่มีคำตอบ; ไม่มีข้อมูล; ไม่ระบุ; เร็วๆ นี้; ว่าง; รอข้อมูล; ลบคำตอบแล้ว; ไม่เกี่ยวข้อง
""".strip().replace("\n", "; ").split("; ")


def _low(points: np.ndarray) -> np.ndarray:
    """Code points with capitals of Latin and Cyrillic as small letters, digits alike."""
    low = np.where(((points >= 65) & (points <= 90)) | ((points >= 0x410) & (points <= 0x42F)), points + 32, points)
    return np.where((low >= 48) & (low <= 57), 48, np.where(low == 0x2019, 39, low)).astype(np.uint32)


def _grams(low: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash buckets of the ``size`` characters that end at each character."""
    mixed = low * np.uint32(2654435761)
    for back, factor in zip(range(1, size), (2246822519, 3266489917, 668265263, 374761393), strict=False):
        mixed[back:] += low[:-back] * np.uint32(factor)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x846CA68B)
    return mixed >> np.uint32(32 - BITS)


#: Line breaks before each text, whose n-grams would reach into the text before it; they count nothing.
_PAD = 4
_WRAP = " \t\r\n\xa0()[]{}<>*_\"'“”«»-–—…"


def _padded(text: str) -> str:
    return "\n" * _PAD + " " + text.strip(_WRAP) + " "


def _inner(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which characters of padded texts aren't padding."""
    out = np.ones(len(points), dtype=bool)
    out[(ends[:-1, None] + np.arange(_PAD)).ravel()] = False
    return out


def counted(texts: list[str]) -> np.ndarray:
    """How often each bucket of 5-grams, and of 3-grams after them, occurs in the texts."""
    out = np.zeros(2 << BITS)
    for low, high in steps(texts):
        points, ends = code_points([_padded(t) for t in texts[low:high]])
        inner, chars = _inner(points, ends), _low(points)
        out[: 1 << BITS] += np.bincount(_grams(chars)[inner], minlength=1 << BITS)
        out[1 << BITS :] += np.bincount(_grams(chars, 3)[inner], minlength=1 << BITS)
    return out


def fit(content: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
    """Log odds of each bucket (5-grams, then 3-grams) for CLASSES against content, from ``counted`` of the corpus and, in a second round, of the texts found of each class in the first."""
    odds = np.zeros((2 << BITS, len(CLASSES)), dtype=np.float32)
    if found is not None:
        content = content - found.sum(axis=0)
    for k, seeds in enumerate((DECLINING, MISSING)):
        own = counted(seeds) * SEED_WEIGHT
        if found is not None:
            own = own + found[k]
        for part in (slice(0, 1 << BITS), slice(1 << BITS, None)):
            kept = np.log((own[part] + 0.3) / (own[part].sum() + 3e4)) - np.log((content[part] + 0.3) / (content[part].sum() + 3e4))
            # what a class's few texts lack doesn't speak for it, however rare it is in the corpus
            odds[part, k] = np.where(own[part] > 0, np.clip(kept, -CLIP, CLIP), np.where(content[part] > 0, np.clip(kept, -CLIP, 0.0), 0.0))
    return odds


def classes(scores: np.ndarray) -> np.ndarray:
    """0 for content, else one more than the place in CLASSES: the class that exceeds its least odds the most."""
    over = scores - np.array(LEAST)
    return np.where(over.max(axis=1) > 0, 1 + over.argmax(axis=1), 0)


def class_scores(texts: list[str], odds: np.ndarray, block: int = 200_000) -> np.ndarray:
    """Mean log odds a character of each text, over its whole length, for CLASSES; very low for empty texts."""
    out = np.full((len(texts), odds.shape[1]), -CLIP)
    columns = [(np.ascontiguousarray(odds[: 1 << BITS, k]), np.ascontiguousarray(odds[1 << BITS :, k])) for k in range(odds.shape[1])]
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= block):
            held += len(texts[end])
            end += 1
        padded = [_padded(t) for t in texts[start:end]]
        points, ends = code_points(padded)
        chars = _low(points)
        fives, threes, padding = _grams(chars), _grams(chars, 3), ~_inner(points, ends)
        for k, (of_fives, of_threes) in enumerate(columns):
            values = of_fives.take(fives) + of_threes.take(threes)
            values[padding] = 0.0
            out[start:end, k] = np.add.reduceat(values, ends[:-1]) / (np.diff(ends) - _PAD)
        start = end
    return out
