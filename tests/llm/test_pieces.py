from __future__ import annotations

import random

import pyarrow as pa
import pytest

from spacelens.llm import piece_viterbi as pv
from spacelens.llm import words


def small(scores=None):
    pieces = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca"]
    kinds = "u" + "b" * 256 + "n" * 11
    rng = random.Random(1)
    scores = scores or [0.0] * 257 + [float(-rng.randint(1, 6)) for _ in range(11)]
    return pv.Vocabulary(tuple(pieces), tuple(scores), kinds)


def brute(encoder, marked):
    """The best total score by plain dynamic programming over all pieces at all places."""
    v = encoder.vocabulary
    best = [0.0] + [float("-inf")] * len(marked)
    for i in range(1, len(marked) + 1):
        for p, s, k in zip(v.pieces, v.scores, v.kinds):
            if k == "n" and marked[:i].endswith(p):
                best[i] = max(best[i], best[i - len(p)] + s)
        if marked[i - 1] not in encoder.singles:
            best[i] = max(best[i], best[i - 1] + encoder.unknown_score)
    return best[-1]


def total(encoder, ids):
    out, v = 0.0, encoder.vocabulary
    run = b""
    for i in ids:
        if v.kinds[i] == "b":
            run += encoder.table[i]
            try:
                run.decode()
            except UnicodeDecodeError:
                continue
            out, run = out + encoder.unknown_score, b""
        else:
            out += v.scores[i]
    return out


def test_best_score_and_round_trip():
    encoder = pv.Encoder(small())
    rng = random.Random(0)
    for _ in range(400):
        text = "".join(rng.choice("aabbcc é\n") for _ in range(rng.randint(0, 14)))
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text
        if text:
            marked = pv.MARK + text.replace(" ", pv.MARK)
            assert total(encoder, ids) == pytest.approx(brute(encoder, marked))


def test_equals_the_library_in_unigram_mode():
    """The library's own Viterbi, on the same pieces; its mark-only pieces' scores are lifted,
    because in its single precision they would drown all others."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pv.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    v = pv.read_vocabulary()
    encoder = pv.Encoder(pv.Vocabulary(v.pieces, tuple(max(s, -40_000.0) for s in v.scores), v.kinds, v.prefix))
    rng = random.Random(2)
    texts = ["The quick brown fox.", "Straße  mit   Lücken ", "unbelievably, internationalisation", "x" * 80]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    for text in texts:
        assert list(encoder.encode(text)) == library.encode(text)


def test_unsafe_cuts_fall_back_to_whole_stretches():
    v = small()
    v = pv.Vocabulary((*v.pieces, "c▁a"), (*v.scores, 9.0), v.kinds + "n")
    encoder = pv.Encoder(v)
    ids = encoder.encode("bc ab")
    assert len(v.pieces) - 1 in ids and encoder.decode(ids) == "bc ab"


def test_links_list_every_ending_piece():
    automaton = pv.Encoder(small()).automaton
    state = 0
    for c in "▁abc":
        state = automaton.follow(state, c)
    assert [length for length, _, _ in automaton.outputs_of(state)] == [3, 2, 1]


def test_messy_documents(messy, no_docs):
    v = pv.read_vocabulary()
    out = pv.encode(messy, v)
    assert out.columns == [*messy.columns, "piece_ids", "round_trip"]
    assert all(r["round_trip"] for r in out.collect())
    back = pv.decode(out.select("doc_id", "piece_ids"), v)
    key = lambda rows: sorted((str(d), t or "") for d, t in rows)
    assert key(back.collect()) == key(messy.select("doc_id", "text").collect())
    assert pv.encode(no_docs, v).count() == 0


def test_normalising_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pv.read_vocabulary(str(path))


def test_results_go_in_batches_of_bounded_size(monkeypatch):
    encoder = pv.Encoder(small())
    rows = ["abc" * (i % 7) if i % 5 else None for i in range(60)] + ["ab" * 50]
    want = [list(encoder.encode(t)) for t in rows]
    for name in ("BATCH_IDS", "BATCH_CHARS"):
        monkeypatch.setattr(pv, name, 12)
        found = list(pv.encoded_rows(encoder, pa.array(rows, pa.string())))
        monkeypatch.undo()
        assert len(found) > 5 and found[0][0] == 0 and found[-1][1] == len(rows)
        assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert [ids for _, _, x, _ in found for ids in x.to_pylist()] == want
        assert all(len(x.flatten()) < 12 + len(x[-1]) for _, _, x, _ in found)
        assert all(all(same.to_pylist()) for *_, same in found)


def test_a_carried_text_goes_to_the_tasks_once(messy):
    def sent(docs, carry=None):
        return pv.encode(docs, small(), carry)._jdf.queryExecution().optimizedPlan().toString()

    assert "__text" not in sent(messy) and "__text" in sent(messy, ["doc_id"])


def test_steps_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(pv, "FOLLOWED", 3)
    encoder = pv.Encoder(small())
    before = sum(map(len, encoder.automaton.step))
    assert encoder.decode(encoder.encode("abcabcab cb ab ca bb cc")) == "abcabcab cb ab ca bb cc"
    assert sum(map(len, encoder.automaton.step)) == before + 3


def test_memory_goes_back_after_a_tasks_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    work = words.giving_back(lambda batches: (2 * b for b in batches))
    at = work([1, 2])
    assert next(at) == 2 and not calls
    assert list(at) == [4] and calls == [1]
