import http.server
import json
import threading

import pytest

from lattica import providers
from lattica.cli import main
from lattica.plans import rag
from lattica.sources.readers import load_run_table


def test_runs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Anna knows Bert. Bert likes tea.")
    main(["questions", f"{tmp_path}/a.txt", "--run", f"{tmp_path}/run"], spark)
    main(["evaluate", "--run", f"{tmp_path}/run"], spark)
    assert load_run_table(spark, f"{tmp_path}/run", "evaluation").count() == load_run_table(spark, f"{tmp_path}/run", "questions").count() == 1
    spark.createDataFrame([(1, "Context: B", {"A": "x", "B": "y"}, "B")], "id int, question string, options map<string,string>, correct string").write.parquet(f"{tmp_path}/mcq")
    main(["benchmark", f"{tmp_path}/mcq", "--run", f"{tmp_path}/run"], spark)
    assert load_run_table(spark, f"{tmp_path}/run", "answers").count() == 1
    judged = load_run_table(spark, f"{tmp_path}/run", "evaluation").first()
    assert judged.rag_answer != "" and judged.answer_correctness_score > 0  # a plain reply is an answer
    spark.createDataFrame([(i, "Context: B", {"A": "x", "B": "y"}, "B", ["train", "test", "test"][i % 3]) for i in range(9)], "id int, question string, options map<string,string>, correct string, split string").write.parquet(f"{tmp_path}/splits")
    main(["benchmark", f"{tmp_path}/splits", "--run", f"{tmp_path}/test", "--split", "test", "--sample", "0"], spark)
    assert load_run_table(spark, f"{tmp_path}/test", "answers").count() == 6
    with pytest.raises(SystemExit) as e:
        main(["benchmark", "x", "--run", "y", "--split", "other"], spark)
    assert e.value.code == 2


def test_http_retriever():
    class Reply(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"contexts": [asked]}).encode())

        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/q"
    assert providers.get("http", url=url).call(["a b"]) == ['{"contexts": ["a b"]}']
    assert providers.get("http", url=url, method="get").call(["a b"]) == ["/q?query=a+b"]
    server.shutdown()


def test_claims(spark):
    told = spark.createDataFrame([(1, '{"claims": [{"subject": "s", "claim": "c", "since": "2020-01-02", "until": "soon"}]}'), (2, "bad")], "doc_id int, reply string")
    row = rag.claims(told).collect()
    assert len(row) == 1 and str(row[0].since) == "2020-01-02" and row[0].until is None
