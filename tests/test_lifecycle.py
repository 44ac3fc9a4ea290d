"""Prompts to requests, answers back to every prompt, and what it cost."""

import json

from pyspark.sql import functions as F

from inkwell.operators import dedup, requests
from inkwell.operators.results import parse_result_lines
from inkwell.schemas import REQUEST_LINE
from inkwell.sources.files import prompt_lines, read_jsonl
from inkwell.sources.sinks import write_jsonl


def test_from_prompts_to_answers(spark, tmp_path):
    texts = [f"prompt {i % 1500} <x>" for i in range(2400)]
    (tmp_path / "p.txt").write_text("\n".join(texts))
    prompts = prompt_lines(spark, str(tmp_path / "p.txt")).withColumnRenamed("prompt_idx", "idx")
    unique = dedup.unique_prompts(prompts).drop("hash")
    requests.enforce_budget(unique, "o1-pro", 10, budget=100.0)
    batches = requests.assign_batches_in_order(unique, ["idx"], max_batch_size=700, ids=F.col("idx"))
    lines = requests.build_requests(batches, "o1-pro").select("batch_no", "custom_id", "method", "url", "body")
    write_jsonl(lines, str(tmp_path / "requests"), partition_by="batch_no")

    folders = sorted(p.name for p in (tmp_path / "requests").glob("batch_no=*"))
    assert folders == ["batch_no=0", "batch_no=1", "batch_no=2"]
    sent = read_jsonl(spark, str(tmp_path / "requests"), REQUEST_LINE).collect()
    assert len(sent) == 1500 and {r["custom_id"] for r in sent} == {str(i) for i in range(1500)}
    answers = [
        json.dumps({
            "custom_id": r["custom_id"], "model": "o1-pro",
            "usage": {"prompt_tokens": 2, "completion_tokens": 1},
            "choices": [{"message": {"role": "assistant", "content": r["body"]["messages"][0]["content"].upper()}}],
        })
        for r in sent
    ]
    (tmp_path / "answers.jsonl").write_text("\n".join(answers))

    flat = parse_result_lines(spark.read.text(str(tmp_path / "answers.jsonl")))
    whole = dedup.in_id_order(dedup.expand_results(prompts, flat.withColumn("seq", F.lit(0)))).collect()
    assert [(r["custom_id"], r["content"]) for r in whole] == [
        (str(i), t.replace("<", "").replace(">", "").upper()) for i, t in enumerate(texts)
    ]
    total = requests.cost_by_model(flat).where("is_total = 1").first()
    assert total["total_cost"] == (1500 * 2 * 75 + 1500 * 300) / 1e6
