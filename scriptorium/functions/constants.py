"""Fixed values that must equal the reference's for identical results.

They are stated once here, in their natural order.
"""

# --- fixed values: section names dropped before prompting (case-insensitive)
PROMPT_EXCLUDED_SECTIONS = (
    "references", "citations", "see_also", "external_links", "notes",
    "bibliography", "further_reading", "see also", "external links",
    "further reading",
)

# --- fixed values: section names dropped by the outline cleaner (after "_" -> " ")
OUTLINE_EXCLUDED_SECTIONS = (
    "references", "see also", "notes", "external links", "bibliography",
    "further reading",
)

# --- fixed values: context window (tokens) per chat model
MODEL_WINDOWS = (
    ("gpt-3.5-turbo", 4096),
    ("gpt-3.5-turbo-0613", 4096),
    ("gpt-3.5-turbo-16k", 16385),
    ("gpt-3.5-turbo-16k-0613", 16385),
    ("gpt-4", 8192),
    ("gpt-4-0613", 8192),
    ("gpt-4-32k", 32768),
    ("gpt-4-32k-0613", 32768),
)

# --- fixed values: chat token accounting
TOKENS_BASE = 3
TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1

# --- fixed values: retrieval defaults
SPARSE_K = 5
DENSE_K = 50
DENSE_KEEP = 5
CHUNK_SIZE = 256
PROMPT_BUDGET = 2048
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- fixed values: METEOR parameters
METEOR_ALPHA = 0.9
METEOR_BETA = 3.0
METEOR_GAMMA = 0.5

# --- fixed values: BLEU weights by order
BLEU_WEIGHTS = {
    1: (1.0, 0.0, 0.0, 0.0),
    2: (0.5, 0.5, 0.0, 0.0),
    3: (1 / 3, 1 / 3, 1 / 3, 0.0),
    4: (0.25, 0.25, 0.25, 0.25),
}
# Smallest positive normal double: the precision used for an n-gram order
# with no hit, so that its log is finite.
FLOAT_MIN = 2.2250738585072014e-308

# --- fixed values: judge reply parsing
JUDGE_MAX_SCORE = 5

# --- fixed values: prompt templates
SECTION_PROMPT_HEAD = 'I have a topic "{keyword}" and a section "{section}" that contains the following documents:\n'
SECTION_PROMPT_TAIL = (
    "\nBased on the above information, you are assigned to write the particular section of a Wikipedia article on the topic.\n"
    'You must cite the most relevant document for every sentence you write, in the format of "This is an example sentence.[k]", where k denotes Document k. \n'
)
OUTLINE_PROMPT_HEAD = 'I have a topic "{keyword}" that contains the following documents:\n'
OUTLINE_PROMPT_TAIL = (
    "\nBased on the above information, you are assigned to write an outline for a Wikipedia article about this topic.\n"
    "Your outline should only include the names of the sections, without any further details.\n"
    "Do not use document name as your outline.\n"
    "The format of your outline should be as follows:\n"
    "1. Introduction\n"
    "2. <Section Name 1>\n"
    "...\n"
    "n. <Section Name n> \n"
)

WRITER_PROMPTS = {
    "vanilla": 'Based on your own knowledge, you are assigned to write a Wikipedia article on the topic.    Organize the content of your article by sections. Before writing each section, always starts with "==SECTION NAME==".',
    "vanilla_given_outline": 'Based on your own knowledge, you are assigned to write a Wikipedia article on the topic.    Follow the given outline to Organize the content of your article by sections. Before writing each section, always starts with "==SECTION NAME==".',
    "writer": 'Based on the given information, you are assigned to write a Wikipedia article on the topic.    Organize the content of your article by sections. Before writing each section, always starts with "==SECTION NAME==".    You must cite the most relevant document for every sentence you write, in the format of "This is an example sentence.[k]", where k denotes Document k.',
    "writer_given_outline": 'Based on the given information, you are assigned to write a Wikipedia article on the topic.    Follow the given outline to organize the content of your article by sections. Before writing each section, always starts with "==SECTION NAME==".    You must cite the most relevant document for every sentence you write, in the format of "This is an example sentence.[k]", where k denotes Document k.',
    "writer_per_section": 'Based on the given information, you are assigned to write a Wikipedia article on the topic.    Only write the specified section. Before writing the section, starts with "==SECTION NAME==".    You must cite the most relevant document for every sentence you write, in the format of "This is an example sentence.[k]", where k denotes Document k.',
    "outline": 'Based on the given information, you are assigned to make an outline for the Wikipedia article on the topic.    List 5~10 sections in the outline, in the format of "==SECTION NAME==".',
    "rewrite": 'Please rewrite the passage below to enhance its fluency and coherence while maintaining the original meaning.     Pay attention to the citation indexes [k] at the end of each sentence; these should remain unchanged if the sentence conveys a similar idea to the original.     Ensuring that the section headings "==HEADING==" remain unchanged. Preserve the length of the passage as much as possible.',
}

JUDGE_SYSTEM_PROMPT = (
    "Evaluate a encyclopedia text of a keyword in three metrics,fluency,informativeness,faithfulness.Give a score from 0-5 to each metric. \n"
    "Fluency: Assess the text for grammatical correctness, coherence of ideas, and overall readability. Look for smooth transitions between sentences and paragraphs, as well as clear organization of information.\n"
    "Informativeness: Evaluate the depth and breadth of information provided about the keyword. Check if the text covers various aspects of the topic, including its definition, background, significance, related concepts, and any relevant examples or applications.\n"
    "Faithfulness: Verify the accuracy of the information presented in the text by cross-referencing with credible sources or established knowledge,assess whether the information aligns with accepted facts and evidence.\n"
    "Only give three scores in this form: Fluency:score1,Informativeness:score2 Faithfulness:socre3.No need to Explaination."
)
JUDGE_USER_TEMPLATE = "Keyword:{KEYWORD}\n    Encyclopedia Text:{WIKITEXT}\n    Scores:"
