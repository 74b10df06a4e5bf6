import random
import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=5):
    """Copies, near copies, shared passages, empty, null, short and long texts."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "Été", "naïve", "x", "data", "漢字"] + [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    near = []
    for k in range(12):
        w = base.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        near.append(" ".join(w))
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", "one two three", base, *near, base, say(5000), say(3), say(40) + " " + passage + " " + say(40)]
    texts += [say(rng.randrange(5, 80)) + (" " + passage if k % 3 == 0 else "") for k in range(30)]
    return texts + [texts[25], "é" * 80, "é" * 81, "a" * 49, "a" * 50, "a" * 51, "a" * 400]


def word_sets(texts, width):
    out = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOW)) if x]
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def classes(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def removed_bytes(texts, length=50):
    """For each text, a mask of its bytes that repeat an earlier text's."""
    first, out = {}, []
    for k, t in enumerate(texts):
        b = (t or "").encode()
        mask = bytearray(len(b))
        own = []
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in first:
                mask[i : i + length] = b"\x01" * length
            else:
                own.append(w)
        for w in own:
            first.setdefault(w, k)
        out.append(mask)
    return out
