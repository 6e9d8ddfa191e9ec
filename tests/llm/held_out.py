"""Answers written by hand that were not looked at while the word classes were chosen: (question, answer, defect)."""

EN = "What is the limit of a loan to a member of staff under these directions?"
FR = "Quelle est la limite d'un prêt à un membre du personnel dans ces directives ?"
DE = "Wie hoch ist die Grenze für ein Darlehen an einen Mitarbeiter nach dieser Richtlinie?"

REFUSALS = [
    "I'm afraid I can't answer that.", "Sorry, I won't be able to assist with this request.", "I am unable to provide an answer based on the given context.", "We are not in a position to respond to this question.",
    "Based on the documents provided, it is not possible to answer this question.", "The passages do not mention this topic, so I cannot say.", "There is not enough information to answer the question.", "I have no idea.", "I don't know the answer to this.",
    "This question is outside my scope.", "That is beyond what I can discuss.", "I must respectfully decline to comment.", "I refuse to answer.", "As a language model, I cannot give legal advice.", "Unfortunately, I'm not permitted to answer questions of this kind.",
    "The context does not contain the answer.", "None of the extracts address this question.", "Not addressed in the provided documents.", "I do not have sufficient details to reply.", "It would be inappropriate; I will not comment on this matter.", "I could not find the answer in the sources, so I cannot help.",
    "Thank you for your question. I'm sorry to say that I cannot help you with this matter. For professional help please consult the website of the regulator, where a form for enquiries can be found, or contact the helpdesk by telephone during office hours. I apologise again and hope you understand. Please do not hesitate to contact the helpdesk with other questions, which a professional will look at within a few days.",
    "Je regrette, je ne peux pas vous répondre.", "Les documents ne permettent pas de répondre à cette question.", "Ich kann diese Frage leider nicht beantworten.", "Dazu kann ich keine Auskunft geben.", "Die Quellen erlauben keine Antwort auf diese Frage.", "Lo siento, pero no puedo responder a esa pregunta.", "Non posso rispondere a questa domanda.", "Não posso responder a esta pergunta.", "Ik kan deze vraag niet beantwoorden.",
]
SOUND = [
    "Loans to staff are not covered by the Direction.", "Auditors may not comment on the draft before it is issued.", "The fee is 5%", "The chief compliance officer of the branch office", "Banks cannot provide loans to their own directors.", "A lender may refuse a request that lacks the form.",
    "The committee must decline any offer above the limit.", "The document does not contain a signature, so it is void.", "No fee may be charged for this service.", "The customer cannot give notice before the end of the term.", "Members of staff may not discuss the case with the press.", "The bank is unable to open an account without a proof of address.",
    "It is not permitted to lend to directors.", "There is no limit.", "No.", "Not applicable to small lenders.", "The register does not allow entries after the closing date.", "Sources of funds must be recorded.", "The lender shall not be able to enforce the pledge without a court order.", "Requests outside the period are returned.", "5 per cent of the paid-up capital", "Within 30 days of receipt", "Paragraph 7(b)", "Yes",
]
OTHER_LANGUAGE = [
    (EN, "Beloppet får inte vara högre än fem procent av kapitalet och det ska redovisas i en not."), (EN, "従業員への貸付の上限は資本の五パーセントです。"), (EN, "Лимит займа составляет пять процентов капитала."), (EN, "대출 한도는 자본의 5퍼센트입니다."), (EN, "Il limite è pari al cinque per cento del capitale e non può essere superato senza una delibera."),
    (EN, "O limite é de cinco por cento do capital e não pode ser ultrapassado sem uma decisão."), (EN, "De grens is vijf procent van het kapitaal en mag niet worden overschreden."), (FR, "The limit is five per cent of the capital and may not be exceeded."), (DE, "La limite est de cinq pour cent du capital et ne peut pas être dépassée."), (DE, "El límite es el cinco por ciento del capital y no se puede superar."),
]
SAME_LANGUAGE = [
    (EN, "The limit is five per cent of the capital."), (EN, "The rule “Der Vertrag ist für die Prüfung zu melden und darf nicht” is quoted in the annex of the directions."), (FR, "La limite est de cinq pour cent du capital."), (DE, "Die Grenze liegt bei fünf Prozent des Kapitals und darf nicht überschritten werden."), (EN, "Paragraph 7 of the La Paz Convention de Facto."),
]
CASES = [
    *[(EN, a, "refusal") for a in REFUSALS], *[(EN, a, None) for a in SOUND], *[(q, a, "language") for q, a in OTHER_LANGUAGE], *[(q, a, None) for q, a in SAME_LANGUAGE],
    *[(EN, a, "truncated") for a in ("The limit is five per cent of the", "The limit (as set out in", "The lender shall keep a record of all lo", "First, the lender checks the form. Second, the lender", "The limit is:", "The limits are as follows:\n1. five per cent for staff;\n2.")],
    *[(EN, a, "echo") for a in ("The limit of a loan to a member of staff under these directions.", "What is the limit of a loan to a member of staff under these directions", "You ask: what is the limit of a loan to a member of staff under these directions?")],
]
