import random

from scoreloom.llm import decontam


def test_copy_far_behind_its_scattered_words():
    """A passage that holds the item's words in another order does not hide a later copy, whole or with one changed word."""
    rng = random.Random(4)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((96, 20, 40))]
    rows = [(k, " ".join(w), " ".join(w), True) for k, w in enumerate(items)]
    frequency = decontam.Counter(w for body in items for w in body)
    index = decontam.build_index(rows, frequency, len(rows), 52.0)
    filler = [f"f{rng.randint(0, 900)}" for _ in range(1000)]
    early = rng.sample(items[1], len(items[1]))
    changed = [*items[1][:-1], "other"]
    texts = [" ".join(early + filler + end + filler) for end in (items[1], changed, rng.sample(items[1], len(items[1])))]
    found = decontam.leaks(index, texts)
    assert [[x["item_id"] for x in hits] for hits in found] == [[1], [1], []]
    assert found[0][0]["overlap"] == 1.0 and 0.8 <= found[1][0]["overlap"] < 1.0
