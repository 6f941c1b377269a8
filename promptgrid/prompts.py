"""Default prompt templates."""

CLASSIFICATION = (
    "Write {num_samples} different short texts in {language_name} that belong to the class '{label_name}', which means: {label_description}. "
    "The classes are {labels_listing}; a reader must be able to tell them apart.",
)
RAW = ("Write {num_samples} texts in {language_name}. Each is a {document_type} about {topic}.",)
CHAT_QUESTIONS = ("In the field of {domain}, list {num_samples} questions in {language_name} that somebody learning about {topic}, and there about {subtopic}, would ask.",)
CHAT_REFORMULATE = "Put this question on {topic} ({subtopic}) into the words of the following person.\nPerson: {persona}\nQuestion: {question}"
CHAT_ANSWER = "You know {domain} well, {topic} and {subtopic} most of all. Answer the question.\nQuestion: {question}"
CHAT_FOLLOW_UP = "The conversation so far, on {subtopic} in {domain}:\n{dialog_summary}\nWhat does this person ask next? Person: {persona}"
MCQ = ("From the document below, make {num_samples} questions in {language_name}, each with the one correct answer that it gives.\nDocument: {document}",)
MCQ_CONTEXT = ("From the document below, read against its context, make {num_samples} questions in {language_name}, each with its correct answer.\nContext: {context}\nDocument: {document}",)
MCQ_DISTRACTORS = "Give three wrong but plausible answers in {language_name}.\nQuestion: {question}\nCorrect answer: {correct_answer}"
PREFERENCE_QUESTIONS = (
    "Write {num_samples} questions in {language_name} that this document answers.\n{document}",
    "Write {num_samples} requests in {language_name} that a reader of this document might make of an assistant.\n{document}",
    "Write {num_samples} questions in {language_name} that need more than one sentence of this document.\n{document}",
)
PREFERENCE_CHOSEN = "Answer in {language_name}, completely and only from the document.\nDocument: {document}\nQuestion: {question}"
PREFERENCE_REJECTED = "Answer in {language_name} in a few words.\nDocument: {document}\nQuestion: {question}"
PREFERENCE_JUDGE = "Rate this answer from 1 to 10 and say why.\nDocument: {document}\nQuestion: {question}\nAnswer: {response}"
