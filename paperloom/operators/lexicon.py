"""Labels, their keyword phrases, the checklist and the section order: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELS = ("Model details", "Limitations, bias, and risk", "Training", "How to use", "Evaluation", "Environmental impact", "Contact")
GAP_THRESHOLD = 0.01
BENEFICIAL_PAIRS = (("Training", "Evaluation"), ("Model details", "Evaluation"))

PHRASES = {
    "Model details": ("base model", "model architecture", "model backbone", "based on transformer", "encoder-decoder", "developed by", "release date", "license type", "reference paper", "disclaimer", "number of layers", "neural network", "model size", "technical report", "cite", "recurrent neural networks", "attention layer", "vision transformer", "transformer-based model", "model parameters count", "model components", "model design", "model variants", "underlying structure", "supported tasks", "model input", "model output", "acknowledgement", "thanks to", "funded by", "expected use", "main use"),
    "Limitations, bias, and risk": ("biased predictions", "fairness", "ethical concern", "risk", "sensitive content", "stereotype", "caution", "unfiltered content", "content warning", "representational harms", "malicious content", "lead to limitations", "influence model capabilities", "prejudiced content", "inherited bias", "demeaning portrayals", "ethical implications", "inductive bias", "bias", "hallucination", "mitigation strategies", "out-of-scope", "unsuitable"),
    "Training": ("data collection", "training dataset", "training procedures", "epoch count", "optimizer type", "trained on gpu", "trained on tpu", "batch size", "learning rate", "warmup rate", "hyperparameters details", "loss function", "data augmentation", "preprocessing", "fine-tuning procedures", "post-training", "pre-training", "training approach", "data filtering", "data preparation process", "how to train", "training", "fine-tuning", "optimizer", "hyperparameters"),
    "How to use": ("quick start", "code snippet", "setup instructions", "reproducibility", "installation guide", "adjustable configuration", "usage tutorial", "install dependencies", "usage documentation", "usage requirements", "how to start", "online demo", "showcase samples", "output examples", "task demonstration", "web demo", "inference script", "run following code", "config file", "installation", "usage", "inference", "run", "demo"),
    "Evaluation": ("model achieve", "evaluation result", "results on benchmark", "automatic evaluation metrics", "test set", "quantitative analysis", "qualitative analysis", "error rate", "outperform", "superior performance", "comparable performance", "evaluation score", "evaluation setup", "held-out data", "performance comparison", "state-of-the-art results", "experiment", "benchmark", "evaluation", "results", "state of the art", "metric"),
    "Environmental impact": ("carbon emission", "cloud provider", "energy consumption", "compute cost", "power usage", "region", "total emissions", "average carbon efficiency", "carbon footprint", "cumulative hours", "cumulative days", "electricity", "power grid", "carbon", "emission", "energy", "power"),
    "Contact": ("contact", "corresponding author", "send feedback", "contributors", "affiliation", "submit github issue", "send questions", "send comments", "send email", "for help", "email", "issue", "feedback", "author"),
}

CHECKLIST = {
    "Model details": ("[Point number 1] A clear description of the mathematical setting, algorithm, and/or model.",),
    "Training": (
        "[Point number 2] For all datasets used, the relevant statistics, such as number of examples.",
        "[Point number 3] The details of train/validation/test splits.",
        "[Point number 4] An explanation of any data that were excluded.",
        "[Point number 5] An explanation of all pre-processing steps.",
        "[Point number 6] A link to the dataset.",
        "[Point number 7] For new data collected, a complete description of the data collection process, such as instructions to annotators and methods for quality control.",
        "[Point number 8] The range of hyper-parameters considered.",
        "[Point number 9] The method to select the best hyper-parameter configuration.",
        "[Point number 10] Specification of all hyper-parameters used to generate results.",
        "[Point number 11] The exact number of training runs.",
        "[Point number 12] A description of the computing infrastructure used.",
    ),
    "Evaluation": (
        "[Point number 13] The exact number of evaluation runs.",
        "[Point number 14] A clear definition of the specific measure or statistics used to report results.",
        "[Point number 15] A description of results with central tendency (e.g. mean) and variation (e.g. error bars).",
        "[Point number 16] The average runtime for each result.",
    ),
    "Environmental impact": ("[Point number 17] Estimated energy cost.",),
    "How to use": ("[Point number 18] Precise command to run to produce reported results.",),
    "Files": ("[Point number 19] Specification of dependencies.", "[Point number 20] Training code.", "[Point number 21] Evaluation code.", "[Point number 22] (Pre-)trained model(s)."),
}


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A constant table as an inline relation, which Catalyst knows the size of."""
    show = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)} AS t({columns})")


def label_table(spark: SparkSession) -> DataFrame:
    return _values(spark, "label_ord, label", list(enumerate(LABELS)))


def phrase_table(spark: SparkSession) -> DataFrame:
    """(label_ord, label, phrase, is_multiword)."""
    return _values(spark, "label_ord, label, phrase, is_multiword", [(i, x, p, " " in p) for i, x in enumerate(LABELS) for p in PHRASES[x]])


def checklist_table(spark: SparkSession) -> DataFrame:
    """(section_ord, section, item_ord, item)."""
    return _values(spark, "section_ord, section, item_ord, item", [(i, s, k, x) for i, (s, items) in enumerate(CHECKLIST.items()) for k, x in enumerate(items)])
