import json
import random

from tidemark.__main__ import main


def lines(path, rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_candles(spark, tmp_path, capsys):
    rows = ["aggTradeId,price,qty,firstTradeId,lastTradeId,timestamp,maker", *(f"{i},{10 + i % 3},1,{i},{i},{i * 1000},True" for i in range(40))]
    main(["candles", lines(tmp_path / "a.csv", rows), str(tmp_path / "out"), "--seconds", "10"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4


def test_features_and_prediction(spark, tmp_path):
    rng, price, rows = random.Random(1), 100.0, []
    for i in range(3000):
        price *= 1 + rng.gauss(0, 0.001)
        rows.append(f"{i},{price:.4f},{rng.random():.4f},1,{1_700_000_000_000_000 + i * 1_000_000},{rng.random() < 0.5},True")
    main(["features", lines(tmp_path / "spot.csv", rows), f"{tmp_path}/matrix.parquet"])
    main(["predict", f"{tmp_path}/matrix.parquet", f"{tmp_path}/model", "--horizon", "10", "--rounds", "2"])
    figures = spark.read.json(f"{tmp_path}/model/metrics").first()
    assert figures["symbol"] == "BTC" and spark.read.parquet(f"{tmp_path}/model/predictions").count() == 120
    assert json.loads(spark.read.text(f"{tmp_path}/model/bundle/config").first()[0])["horizon"] == 10


def test_backtest(spark, tmp_path):
    rng, rows = random.Random(2), ["ts,Open,High,Low,Close,Volume"]
    for i in range(300):
        c = 100 + 5 * rng.gauss(0, 1)
        rows.append(f"2024-01-{2 + i // 100:02d} 10:{i % 60:02d}:{i % 50:02d},{c},{c + 1},{c - 1},{c},{rng.random()}")
    main(["backtest", lines(tmp_path / "bars.csv", rows), f"{tmp_path}/out"])
    assert spark.read.json(f"{tmp_path}/out/performance").first()["num_trades"] >= 0
