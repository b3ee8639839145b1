"""Ten made-up documents that hit the parser's rules: labelled lines, blank
lines, a hyphenated name, a keyword inside a longer word ("mit" in "Hermit"),
a break with caregiving, and one without any known skill."""

TEXTS = {
    "cv_01.txt": "Nora Taylor\nEmail: nora.taylor@post.example\n\nSkills: Python, pandas, statistics, machine learning, REST API, Git\n\n"
                 "Education: MSc Statistics, Oxford, 2016\n\nExperience:\n- Built forecasts for a harbour authority with pandas\n- Keeps a Python package for tide tables in Git",
    "cv_02.txt": "Vikram Rao\nEmail: v.rao+jobs@mail.example.org\n\nSkills: SQL, Excel, Tableau, pandas\n\n"
                 "Education: MBA, Lakeside College, 2014\n\nExperience:\n- Weekly sales boards in Tableau\n- Cleans survey tables with SQL and pandas",
    "cv_03.txt": "Peter Jones\nEmail: peter@jones.example\n\nSkills: Java, Docker, Kubernetes, microservices\n\n"
                 "Education: B.Sc Informatics, Northern College, 2012\n\nExperience:\n- Runs payment services in Docker on Kubernetes\n- Earlier at Hermit Software, billing in Java",
    "cv_04.txt": "Leila Al-Amin\nEmail: leila.al-amin@example.net\n\nSkills: Python, NLP, spaCy, NLTK, SQL\n\n"
                 "Education: Master of Linguistics, Edinburgh, 2011\n\nExperience:\n- Tagged court records with spaCy and NLTK\n- Career break, caregiving at home, 2018 to 2019\n- Since then SQL reports for a library",
    "cv_05.txt": "Deepa Kumar\nEmail: deepa@kumar.example\n\nSkills: React, node.js, MongoDB\n\n"
                 "Education: MCA, Hill College, 2020\n\nExperience:\n- Shop pages in React\n- Order service in node.js with MongoDB",
    "cv_06.txt": "Grace Williams\nPlanner\nEmail: grace.williams@example.com\nSkills: Excel\nEducation: Bachelor of Arts, River College, 2009\nExperience: timetables for a bus company\n",
    "cv_07.txt": "Olaf Berg\nCarpenter\nEmail: olaf.berg@example.com\nSkills: joinery, roofing\nEducation: BSc Wood Science, Fjord College, 2013\nExperience: roofs and stairs",
    "cv_08.txt": "Mei Tanaka\nResearcher\nEmail: mei.tanaka@example.com\nSkills: PyTorch, computer vision, Python\nEducation: PhD Optics, Bay College, 2021\nExperience: lens tests by computer vision",
    "cv_09.txt": "Henry Brown\nNetwork engineer\nEmail: henry.brown@example.com\nSkills: routing, Python, AWS\nEducation: B.Tech Networks, Coast College, 2015\nExperience: moved offices to AWS",
    "cv_10.txt": "Clara Wilson\nTeacher\nEmail: clara.wilson@example.com\nSkills: statistics, data analysis\nEducation: M.Sc Mathematics, Valley College, 2010\nExperience: school tests and their data analysis",
}

QUERY = ("Wanted: someone who writes Python every day, cleans tables with pandas and SQL, knows NLP tools such as spaCy or NLTK, "
         "keeps work in Git and can put a REST API in front of a data analysis.")
