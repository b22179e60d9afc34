import random


def vocabulary(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(n, seed):
    words, rng = vocabulary(), random.Random(seed)
    return [rng.choice(words) for _ in range(n)]
