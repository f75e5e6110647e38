import numpy as np
import pytest

from corpusloom.functions.audio import log_mel, log_mel_udf, mel_bank, speech_fbank


def tone(hz, rate, seconds=0.5):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def test_bank_is_slaney_normalised():
    bank = mel_bank(22050, 1024, 80)
    assert bank.shape == (80, 513) and (bank >= 0).all()
    assert bank[40:].sum(axis=1) * 22050 / 1024 == pytest.approx(np.ones(40), rel=0.05)


@pytest.mark.parametrize("hz", [300, 1000, 4000])
def test_a_tone_peaks_in_its_band(hz):
    rate = 22050
    centres = mel_bank(rate, 1024, 80).argmax(axis=1) * rate / 1024
    for centred in (True, False):
        m = log_mel(tone(hz, rate), rate, centred=centred)
        assert abs(centres[m[10].argmax()] - hz) < 120
    f = speech_fbank(np.concatenate([tone(hz, 16000), 0.01 * tone(hz * 1.7, 16000)]))
    assert f.shape[1] == 80 and f.mean(axis=0) == pytest.approx(np.zeros(80), abs=1e-9)


def test_frame_counts_and_short_input():
    assert len(log_mel(np.zeros(22050))) == 22050 // 256 + 1
    assert len(log_mel(np.zeros(2560), centred=False)) == 10
    assert len(speech_fbank(np.zeros(16000))) == 98 and len(speech_fbank(np.zeros(399))) == 0
    assert log_mel(np.zeros(0)).shape == (0, 80) and log_mel(np.zeros(1)).shape == (1, 80)
    assert np.allclose(log_mel(np.zeros(4096)), np.log(1e-5))


def test_direct_transform_agrees():
    x, n, hop = np.random.default_rng(1).normal(size=700), 64, 16
    padded = np.pad(x, 32, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    k = np.exp(-2j * np.pi * np.outer(np.arange(33), np.arange(n)) / n)
    want = np.array([np.log(np.maximum(mel_bank(16000, n, 8) @ np.abs(k @ (padded[i : i + n] * window)), 1e-5)) for i in range(0, len(padded) - n + 1, hop)])
    assert log_mel(x, 16000, n, hop, 8) == pytest.approx(want)


def test_udf(spark):
    df = spark.createDataFrame([([0.0] * 512,), (None,)], "w array<double>")
    got = [r.m for r in df.select(log_mel_udf(n_fft=256, hop=64, bands=4)("w").alias("m")).collect()]
    assert len(got[0]) == 9 and len(got[0][0]) == 4 and got[1] is None
