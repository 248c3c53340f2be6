"""Missing or wrong language labels and mixed-language text (problem 4).

Multinomial naive Bayes over hashed character n-grams of the consistent form. It is fitted on a bounded sample of
labelled rows (DOCS_PER_LABEL documents a label by hash order, all eval_items) and a short list of common words of each
language, so that it is defined for tables of any size; each training text counts with and without its accents. Labels
may be wrong, so a second fit leaves out the sentences that the first one gives to another language. The matrix of log
probabilities (BUCKETS x 6 floats, 3 MB) is broadcast; batches are scored as sparse sums in numpy.

A query is cut into sentences; a sentence that tells nothing goes with the one before it; runs of one language are
segments. Descriptions are scored once per distinct text and worker.

Cases: null, blank or letterless queries have no segments and their records no rows; null or blank descriptions are
left out; labels are codes of two or three letters in any case with or without region, all else counts as missing or as
another language; texts of any length are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.textform import consistent

LANGS = ("en", "vi", "fr", "de", "es", "ru")
ORDERS, BUCKETS, DOCS_PER_LABEL = (2, 3, 4), 1 << 17, 300
SMOOTHING, MARGIN = 0.05, 4.0
# Language codes of two and three letters.
CODES = {"en": "en", "eng": "en", "vi": "vi", "vie": "vi", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es", "ru": "ru", "rus": "ru"}
MISSING = ("", "und", "unknown")
# Common words.
COMMON = {
    "en": "the of and to in is that it for on with as was at by this be from are have not or an which you but they his her all one will would there been if can has more when who so what up out about into than them only other time some could these two may then do first any my now such like our over me even most made after also did many before must through back where much your way well down should because each just those people how too little good please when what does before",
    "vi": "của và là có được cho một không trong các những với người đã này để khi từ đến như về tại ra vào năm cũng trên nhiều sau phải theo bị nhưng tôi bạn anh chị còn lại đó nếu thì rồi chưa làm sẽ hay hoặc giúp mình ngày tháng giờ muốn hãy xin ở nào gì đâu bao nhiêu chúng ta họ nó rất hơn nhất vì nên mà do bởi trước đi lên xuống mới cùng giữa thêm số tên",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle nous vous je ne se plus par sont ont été cette mais ou où son sa ses leur tout comme fait être avoir aux même si sans peut deux après avant aussi bien encore très quand donc chez mon ma mes votre notre cela dès merci quel quelle combien",
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine einen einem einer als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann ich mir mich wir uns ihr wenn was dann schon bitte sehr unter soll muss gibt welche wann wo",
    "es": "el la los las de del un una y es en que a por con para no se su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otra él tanto esa estos mucho cuánto cuál dónde por favor",
    "ru": "и в не на я что он с как это по но они к у из за вы то так же от бы для мы его о она если уже или ни быть был до вас нибудь опять когда мне нет даже ну вдруг ли тут где есть надо ней чем была сам чтоб без будто чего раз тоже себе под будет какой только свою этот тот через эти нас про всего них какая много разве пожалуйста мой можно сколько кто после который",
}
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»)\]]*\s+|[\n\r]+")
_SPACE = re.compile(r"[\W\d_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text in consistent form that hold a letter."""
    return [s for s in _SPLIT.split(text) if s and any(c.isalpha() for c in s)]


def without_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D") if not s.isascii() else s


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text and the number of the text it is from, ordered by text within an order."""
    lines = [f" {_SPACE.sub(' ', t.lower()).strip()} " for t in texts]
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), [len(x) for x in lines])
    hs, ts = [], []
    h = code.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ code[n - 1 :]
        if n in ORDERS:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)
            ok = owner[: len(h)] == owner[n - 1 :]
            hs.append(x[ok]), ts.append(owner[: len(h)][ok])
    return np.concatenate(hs) if hs else np.zeros(0, np.uint32), np.concatenate(ts) if ts else np.zeros(0, np.int32)


def scores(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Log likelihood of each text (rows) in each language."""
    out = np.zeros((len(texts), len(LANGS)), np.float64)
    for i in range(0, len(texts), 2000):
        h, t = _grams(texts[i : i + 2000])
        for j in range(len(LANGS)):
            out[i : i + 2000, j] = np.bincount(t, weights=model[j][h], minlength=len(texts[i : i + 2000]))
    return out


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """Log probabilities, one row for each language, balanced so that no language gains by the size of its sample."""
    counts = np.zeros((len(LANGS), BUCKETS))
    lab = np.array(labels)
    for i in range(0, len(texts), 2000):
        h, t = _grams(texts[i : i + 2000])
        np.add.at(counts, (lab[i : i + 2000][t], h), 1.0)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    share = share * 1e5 + SMOOTHING  # every language weighs 100,000 n-grams
    return np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)


def label_of(c: Column) -> Column:
    """The language that a label names, 'other' for codes of others, null if it is missing."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    main = F.regexp_extract(low, "^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.coalesce(*[F.when(main == k, F.lit(v)) for k, v in CODES.items()])
    return F.when(~low.isin(*MISSING), F.coalesce(known, F.lit("other")))


def train(documents: DataFrame, items: DataFrame) -> np.ndarray:
    """Fit on the bounded sample; see above. One pass over keys and labels, one over the texts of the sample."""
    ids = documents.select("doc_id", label_of(F.col("lang")).alias("label")).where(F.col("label").isin(*LANGS) & F.col("doc_id").isNotNull())
    # the limit of each label is taken within every partition before anything is shuffled
    nth = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    keep = [r[0] for r in ids.withColumn("nth", nth).where(F.col("nth") <= DOCS_PER_LABEL).select("doc_id").collect()]
    rows = documents.where(F.col("doc_id").isin(keep)).select("text", label_of(F.col("lang")).alias("label")).union(items.orderBy("item_id").limit(5000).select("text", label_of(F.col("lang")))).collect()
    return fit_rows([(r[0], r[1]) for r in rows])


def fit_rows(rows: list[tuple[str | None, str | None]]) -> np.ndarray:
    texts, labels = [], []
    for text, label in rows:
        if text and label in LANGS:
            for s in dict.fromkeys(sentences(consistent(text))):
                texts.append(s)
                labels.append(LANGS.index(label))
    base = [(x, LANGS.index(k)) for k, v in COMMON.items() for x in (v, without_accents(v))]
    seed_t, seed_l = [x for x, _ in base], [x for _, x in base]

    def both(t: list[str], lab: list[int]) -> np.ndarray:
        plain = [(without_accents(x), y) for x, y in zip(t, lab) if not x.isascii() and y != LANGS.index("ru")]
        return fit(seed_t * 3 + t + [x for x, _ in plain], seed_l * 3 + lab + [y for _, y in plain])

    model = both([], []) if not texts else both(texts, labels)
    for _ in range(2):
        if not texts:
            break
        best = scores(texts, model).argmax(axis=1)
        good = [i for i, b in enumerate(best.tolist()) if b == labels[i]]
        model = both([texts[i] for i in good], [labels[i] for i in good])
    return model


def settle(rows: np.ndarray) -> list[int]:
    """The language of each sentence of one text; a sentence within MARGIN of its neighbour's language follows it."""
    best = rows.argmax(axis=1).tolist()
    gap = rows.max(axis=1)
    sure = [gap[i] - np.partition(rows[i], -2)[-2] >= MARGIN for i in range(len(rows))]
    prev = next((b for b, s in zip(best, sure) if s), int(rows.sum(axis=0).argmax()))
    for i in range(len(best)):
        if not sure[i] and gap[i] - rows[i, prev] < MARGIN:
            best[i] = prev
        prev = best[i]
    return best


def segments(rows: np.ndarray) -> list[tuple[int, float]]:
    """(language, confidence) of each maximal run; confidence is the posterior of the run's language."""
    best = settle(rows)
    out, i = [], 0
    while i < len(best):
        j = i
        while j < len(best) and best[j] == best[i]:
            j += 1
        x = rows[i:j].sum(axis=0)
        out.append((best[i], float(1 / np.exp(np.minimum(x - x[best[i]], 700)).sum())))
        i = j
    return out


def text_segments(texts: list[str | None], model: np.ndarray) -> list[list[tuple[int, float]]]:
    """The segments of each text."""
    cut = [sentences(consistent(t)) if t else [] for t in texts]
    flat = [s for c in cut for s in c]
    sc = scores(flat, model)
    out, k = [], 0
    for c in cut:
        out.append(segments(sc[k : k + len(c)]) if c else [])
        k += len(c)
    return out


ROWS = "rid long, field string, pos int, lang string, confidence double, label string, n_segments int, first string"


def languages(spark: SparkSession, records: DataFrame, model: np.ndarray) -> DataFrame:
    """One row for each segment of each query and each non-blank description: its language and confidence, the label of
    the record, the number of segments of its query and the language of the first one."""
    share = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        known: dict[str, tuple[int, float]] = {}
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                segs = text_segments(b.column("query").to_pylist(), m)
                descs = b.column("descs").to_pylist()
                new = list({d for ds in descs for d in ds or () if d and d not in known})
                if len(known) + len(new) > 100_000:
                    known = {}
                    new = list({d for ds in descs for d in ds or () if d})
                sc = scores([consistent(d) for d in new], m)
                for d, x in zip(new, sc):
                    k = int(x.argmax())
                    known[d] = (k, float(1 / np.exp(np.minimum(x - x[k], 700)).sum())) if any(c.isalpha() for c in d) else (-1, 0.0)
                out: list[list] = [[] for _ in range(8)]
                for rid, label, sg, ds in zip(b.column("rid").to_pylist(), b.column("label").to_pylist(), segs, descs):
                    if not sg:
                        continue
                    rows = [("query", p, k, c) for p, (k, c) in enumerate(sg)] + [("tools", p, *known[d]) for p, d in enumerate(ds or ()) if d and known[d][0] >= 0]
                    for field, p, k, c in rows:
                        for col, v in zip(out, (rid, field, p, LANGS[k], c, label, len(sg), LANGS[sg[0][0]])):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.string()))],
                    names=["rid", "field", "pos", "lang", "confidence", "label", "n_segments", "first"],
                )

    r = records.select("rid", "query", label_of(F.col("language")).alias("label"), F.transform("tools", lambda t: t["description"]).alias("descs"))
    return r.mapInArrow(run, ROWS)


def found(spark: SparkSession, records: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, field, pos, lang) of the missing or wrong labels, the mixed queries and the foreign descriptions."""
    x = languages(spark, records, train(documents, items))
    q = (F.col("field") == "query") & (F.col("label").isNull() | (F.col("n_segments") > 1) | (F.col("label") != F.col("lang")))
    t = (F.col("field") == "tools") & (F.col("lang") != F.col("first"))
    return x.where(q | t).select("rid", "field", "pos", "lang")
