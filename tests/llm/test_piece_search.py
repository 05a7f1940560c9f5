import random

from folioflow.llm import piece_transducer, queries


class Counted(dict):
    looks = 0

    def get(self, *args):
        self.looks += 1
        return super().get(*args)


def words(n, seed=1):
    rng, parts = random.Random(seed), "the er ou tion eau schä lich éq ñó ing und str a e n x q . , $".split()
    return ["▁" + "".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(n)]


def test_arcs_are_looked_up_by_piece_not_by_character():
    fst = piece_transducer.Transducer(queries.piece_model())
    fst.trie = Counted(fst.trie)
    some = words(3000)
    for w in some:
        assert fst.path(w) == fst.merge(w)
    assert fst.trie.looks < 0.7 * sum(map(len, some))


def test_words_met_again_stay_when_a_memo_is_full(monkeypatch):
    monkeypatch.setattr(piece_transducer, "MEMO_MOST", 50)
    fst, made = piece_transducer.Transducer(queries.piece_model()), []
    fst.memo.make = lambda part: made.append(part) or fst.emit(part)
    text = " ".join(f"the {w[1:]}" for w in dict.fromkeys(words(900)))
    ids = fst.encode(text)
    assert fst.decode(ids) == text and made.count("▁the") <= 2 and len(made) > 500
    assert len(fst.memo) <= 50 and len(fst.memo.old) <= 50


def test_pairs_of_pieces_are_bounded(monkeypatch):
    fst, some = piece_transducer.Transducer(queries.piece_model()), words(400, 2)
    want = [fst.path(w) for w in some]
    monkeypatch.setattr(piece_transducer, "PAIRS_MOST", 20)
    few = piece_transducer.Transducer(queries.piece_model())
    for w, path in zip(some, want):
        assert few.path(w) == path and sum(map(len, few.pairs.values())) < 20 + 40 * len(w)
