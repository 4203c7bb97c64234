"""Small documents with the cases that every operator must bear."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x1", "the", "of", "and", "so", "run", "RUN", "end."]


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    draw = random.Random(seed)
    text = lambda k: " ".join(draw.choice(WORDS) + draw.choice(["", "", str(draw.randrange(30))]) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            out.append(text(draw.randrange(5, 120)))
        elif kind == 1:
            out.append(text(20) + "\n" + passage + " " + text(20))
        elif kind == 2:
            out.append(out[draw.randrange(len(out))])
        elif kind == 3:
            words = (out[0] or "a b").split()
            words[draw.randrange(len(words))] = "edited"
            out.append(" ".join(words))
        elif kind == 4:
            out.append("\n".join(["same line here"] * draw.randrange(1, 40)))
        elif kind == 5:
            out.append("a " * draw.randrange(0, 90))
        elif kind == 6:
            out.append(text(3))
        else:
            out.append([None, "", " \n\t "][draw.randrange(3)])
    out.append(" ".join("ab" for _ in range(3000)) + " " + passage)
    return [(i, t, f"src{i % 3}" if i % 11 else None) for i, t in enumerate(out)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string, source string")
