"""Word lists that results depend on."""

# Stop words of the hashed-TF embedding.
EMBED_STOP = "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under and but or yet so if because although though while where when that which who whom whose what this these those i me my myself we our you your he him his she her it its they them their def return else class import try except finally pass none true false self cls not".split()

# Stop words of keyword extraction.
KEYWORD_STOP = "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under and but or yet so if because although though while where when that which who whom whose what this these those i you he she it we they me him her us them my your his its our their mine yours hers ours theirs myself yourself himself herself itself ourselves yourselves themselves".split()

# Technical terms, which count three times as keywords.
TECH_TERMS = "api database db sql nosql redis cache server client frontend backend fullstack microservice monolith docker kubernetes k8s aws gcp azure cloud lambda serverless auth authentication authorization jwt oauth password token session cookie encryption https ssl tls security firewall vpn react vue angular svelte ui component hook state props redux context node nodejs express fastapi django flask spring rails laravel python javascript typescript java go golang rust c++ c# ruby php kotlin swift dart flutter testing test unittest pytest jest mocha cypress selenium e2e integration coverage git github gitlab ci cd pipeline jenkins githubactions travis circleci refactor rewrite migrate upgrade update fix bugfix hotfix patch optimize performance memory cpu speed latency architecture design pattern solid dry kiss clean hexagonal domain ddd".split()

# Stop words of relevance scoring.
SCORE_STOP = "the a an is are was were be been have has had do does did will would could should may might must can to of in for on with at by from as and but or yet so it this that these those i you he she we they".split()
