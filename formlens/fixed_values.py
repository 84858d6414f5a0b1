"""Results depend on them letter by letter, so they are data, not code."""

# The pieces a prompt format is built from, in catalogue order.
SEPARATORS = [
    "", "::: ", ":: ", ": ", " \n\t", "\n    ", " : ", " - ", " ", "\n ", "\n\t", ":", "::", "- ", "\t",
]
SPACES = [
    "", " ", "\n", " \n", " -- ", "  ", "; \n", " || ", " <sep> ", " -- ", ", ", " \n ", " , ", "\n ", ". ", " ,  ",
]

# Descriptor transforms and the spelling the JSON files use for them.
TRANSFORM_SPELLINGS = {
    "identity": "lambda x: x",
    "title": "lambda x: x.title()",
    "upper": "lambda x: x.upper()",
    "lower": "lambda x: x.lower()",
}
TRANSFORMS = list(TRANSFORM_SPELLINGS)

# Descriptors, tags, and the separator between reasoning and answer.
DESCRIPTORS = ("question", "reasoning", "answer")
INSTRUCTION_TAG = "<input>"
RESPONSE_TAG = " <robustness_on>"
END_TAG = "<end_of_response>"
ANSWER_SEPARATOR = "####"

# Strings that end a generation.
STOP_STRINGS = ["Question", "question", "QUESTION", "</s>", "<|im_end|>", "You are an AI assistant", END_TAG]

# What counts as a number, and what is trimmed around an answer.
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
ANSWER_TRIM = " .,()\n-><"

# Display names of the known experiments, in report order.
MODEL_NAMES = {
    "Llama-3.2-1B-Instruct": "Llama-3.2-1B",
    "Llama-3.2-1B-Instruct_lora": "Llama-3.2-1B LoRA",
    "Llama-3.2-3B-Instruct": "Llama-3.2-3B",
    "Llama-3.2-3B-Instruct_lora": "Llama-3.2-3B LoRA",
    "Meta-Llama-3.1-8B-Instruct": "Meta-Llama-3.1-8B",
    "Meta-Llama-3.1-8B-Instruct_lora": "Meta-Llama-3.1-8B LoRA",
    "qwen1b": "Qwen2.5-1.5B",
    "Qwen2.5-1.5B-Instruct_lora": "Qwen2.5-1.5B LoRA",
    "qwen3b": "Qwen2.5-3B",
    "Qwen2.5-3B-Instruct_lora": "Qwen2.5-3B-LoRA",
    "Qwen2.5-7B-Instruct": "Qwen2.5-7B",
    "Qwen2.5-7B-Instruct_lora": "Qwen2.5-7B LoRA",
}
MODEL_FAMILIES = ["Llama", "Qwen"]
