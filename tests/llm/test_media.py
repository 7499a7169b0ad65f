import numpy as np

from weftline.llm import media as M


def test_round_trip_and_peaks(docs, none):
    for x in (b"", b"a", b"x" * 64, bytes(range(256)) * 9):
        back, rate = M.from_wav(M.to_wav(M.payload(x)))
        assert back[: len(x)] == x and len(back) % 64 == 0 and len(back) >= 64 and rate == M.RATE
        assert set(back[len(x) :]) <= {0}
    tone = (128 + 100 * np.sin(2 * np.pi * 40 / M.FRAME * np.arange(4000))).astype(np.uint8).tobytes()
    peaks = M.fingerprints(tone)
    assert {int(p) >> 16 & 0xFFFF for p in peaks if int(p) & 15} == {40} and (np.diff(peaks) >= 0).all()
    assert (M.fingerprints(tone) == peaks).all()
    got = {r.doc_id: r for r in M.media_digests(docs).collect()}
    assert (got[2].n_bytes, got[2].payload_bytes) == (0, 64) and got[2].feature == got[3].feature and got[1].media_sha256 == got[5].media_sha256
    assert M.media_digests(none).count() == 0
    held = M.media_column(docs)
    assert held.count() == 8 and M.media_features(held).where("doc_id = 4").first().peaks


def test_blocks_of_frames():
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    one, many = (np.concatenate(list(M.spectra(x, block=b))) for b in (4096, 3))
    assert np.allclose(one, many)
