"""Given names by language, the common ones of the last decades, for names without title or cue.

Put together by hand without a network: no public register stands behind them, so they are not complete. Names that are
also everyday words or places (Will, Hope, Paris) are left out unless they are very common as names (Mark, Grace).
"""

# Fixed values.
_NAMES = {
    "en": "Aaron Abigail Adam Adrian Aidan Alan Albert Alex Alexander Alexandra Alexis Alfred Alice Alicia Alison Allison Alyssa Amanda Amber Amelia Amy Andrea Andrew Angela Ann Anna Anne Annie Anthony Archie Arnold Arthur "
    "Ashley Audrey Ava Barbara Barry Beatrice Becky Ben Benjamin Bernard Bert Beth Bethany Betty Beverly Billy Bob Bobby Bradley Brandon Brenda Brendan Brett Brian Bruce Bryan Caleb Callum Cameron Carl Carol Caroline Carolyn "
    "Catherine Cathy Charles Charlie Charlotte Chelsea Cheryl Chloe Chris Christian Christina Christine Christopher Cindy Claire Clara Clarence Clive Cody Colin Connie Connor Craig Curtis Cynthia Daisy Damian Daniel Danielle Danny "
    "Darren Dave David Dean Deborah Debra Declan Denise Dennis Derek Diana Diane Dominic Donald Donna Doris Dorothy Douglas Duncan Dylan Eddie Edith Edward Edwin Eileen Elaine Eleanor Elizabeth Ella Ellen Ellie Elsie Emily Emma "
    "Eric Erica Erin Ernest Ethan Ethel Eugene Eva Evan Evelyn Felicity Finn Fiona Florence Frances Francis Frank Fred Freddie Frederick Gabriel Gareth Gary Gavin Gemma Geoffrey George Georgia Gerald Geraldine Gertrude Gillian Gina "
    "Gladys Glenn Gloria Gordon Grace Graham Greg Gregory Gwen Hannah Harold Harriet Harry Harvey Hazel Heather Heidi Helen Henry Herbert Hilary Holly Howard Hugh Ian Imogen Irene Isaac Isabel Isabella Isla Ivy Jack Jackie Jackson "
    "Jacob Jacqueline Jade Jake James Jamie Jane Janet Janice Jason Jean Jeff Jeffrey Jenna Jennifer Jenny Jeremy Jerome Jerry Jesse Jessica Jill Jim Jimmy Joan Joanna Joanne Jodie Joe Joel John Johnny Jon Jonathan Jordan Joseph "
    "Josephine Josh Joshua Joyce Judith Judy Julia Julian Julie Justin Karen Kate Katherine Kathleen Kathryn Kathy Katie Kayla Keith Kelly Ken Kenneth Kerry Kevin Kieran Kim Kimberly Kirsty Kyle Lauren Laura Laurence Lawrence Leah "
    "Lee Leo Leon Leonard Leslie Lewis Liam Lillian Lily Linda Lindsay Lindsey Lisa Logan Lois Lorraine Louis Louise Lucas Lucy Luke Lydia Lynn Mabel Madeleine Madison Malcolm Marcus Margaret Maria Marie Marilyn Marion Marjorie Mark "
    "Martha Martin Marvin Mary Mathew Matt Matthew Maureen Maurice Megan Melanie Melissa Meredith Mia Michael Michelle Mike Mildred Millie Mitchell Mohamed Mohammed Moira Molly Monica Muhammad Muriel Nancy Naomi Natalie Natasha "
    "Nathan Nathaniel Neil Nicholas Nicola Nicole Nigel Noah Noel Nora Norma Norman Oliver Olivia Oscar Owen Pamela Patricia Patrick Paul Paula Pauline Peggy Penelope Penny Peter Phil Philip Phillip Phoebe Phyllis Poppy Rachael "
    "Rachel Ralph Randy Raymond Rebecca Reginald Rhys Richard Rick Ricky Riley Rita Rob Robert Roberta Robin Rodney Roger Roland Ron Ronald Ronnie Rory Rosemary Rosie Ross Rowan Roy Russell Ruth Ryan Sally Sam Samantha Samuel "
    "Sandra Sara Sarah Scott Sean Sebastian Shane Shannon Sharon Shaun Shawn Sheila Shirley Sidney Simon Sophia Sophie Stacey Stacy Stanley Stella Stephanie Stephen Steve Steven Stewart Stuart Susan Suzanne Sylvia Tammy Tara Ted "
    "Terence Teresa Terry Theodore Theresa Thomas Tiffany Tim Timothy Tina Toby Todd Tom Tommy Tony Tracey Tracy Travis Trevor Tristan Tyler Valerie Vanessa Vera Veronica Vicky Victor Vincent Violet Virginia Vivian Walter Wanda Warren "
    "Wayne Wendy Wesley William Winifred Yvonne Zachary Zoe",
    "de": "Achim Adelheid Albrecht Alexander Alexandra Alfons Alfred Alina Almut Amelie Andrea Andreas Angela Angelika Anita Anja Anke Anna Anne Anneliese Annemarie Annette Annika Antje Antonia Antonie Arne Arno August Axel Barbara Bastian "
    "Beate Benedikt Benjamin Benno Bernd Bernhard Bert Berthold Bettina Bianca Birgit Björn Bodo Boris Brigitte Britta Bruno Burkhard Carina Carla Carmen Carola Carolin Carsten Charlotte Christa Christel Christian Christiane Christina "
    "Christine Christoph Clara Claudia Clemens Constanze Cornelia Corinna Dagmar Daniel Daniela David Dennis Detlef Diana Dieter Dietmar Dietrich Dirk Dominik Dora Doreen Doris Dörte Eberhard Eckhard Edeltraud Edith Egon Elena Elfriede "
    "Elias Elisabeth Elke Ella Ellen Elsa Emil Emilia Emma Enrico Erich Erik Erika Erna Ernst Erwin Eva Evelyn Fabian Felix Ferdinand Finn Florian Frank Franz Franziska Frauke Frederik Frieda Friederike Friedhelm Friedrich Fritz Gabi "
    "Gabriele Georg Gerald Gerda Gerd Gerhard Gerlinde Gero Gertrud Gisela Gottfried Greta Gudrun Guido Günter Günther Gunther Gustav Hanna Hannah Hannelore Hannes Hans Harald Hartmut Hedwig Heidemarie Heidi Heike Heiko Heiner Heinrich "
    "Heinz Helena Helene Helga Helmut Hendrik Henning Henrik Henry Herbert Hermann Hilde Hildegard Holger Horst Hubert Hugo Ida Ilona Ilse Ina Ines Inge Ingeborg Ingo Ingrid Irene Iris Irmgard Isabell Isabella Jakob Jan Jana Janina "
    "Jannik Jennifer Jens Jessica Joachim Jochen Johann Johanna Johannes Jonas Jonathan Jörg Jörn Josef Judith Julia Julian Juliane Jürgen Jutta Kai Karin Karina Karl Karla Karsten Katharina Kathrin Katja Katrin Kerstin Kevin Kilian "
    "Klara Klaus Knut Konrad Konstantin Kristin Kristina Kurt Lara Lars Laura Laurin Lea Lena Leni Leo Leon Leonard Leonhard Leonie Levin Liam Lieselotte Lina Linus Lisa Lothar Lotte Louis Luca Ludwig Luis Luisa Lukas Lutz Maik Maja Malte "
    "Manfred Manuel Manuela Marc Marcel Marco Marcus Mareike Margarete Margit Margot Margret Maria Marianne Marie Marina Mario Marion Marius Marko Markus Marlene Marlies Marta Martha Martin Martina Marvin Mathias Mathilda Matthias Max "
    "Maximilian Maya Meike Melanie Mia Michael Michaela Mike Mira Miriam Mohammed Monika Moritz Nadine Nadja Natalie Nele Nick Nicole Niclas Niels Nikolaus Nils Nina Nico Noah Nora Norbert Olaf Oliver Oskar Oswald Otto Pascal Patricia "
    "Patrick Paul Paula Pauline Peer Peter Petra Philipp Philip Pia Rainer Ralf Raphael Rebecca Regina Reiner Reinhard Reinhold Renate René Ricarda Richard Rita Robert Robin Roland Rolf Roman Romy Ronny Rosemarie Roswitha Rudi Rudolf Ruth "
    "Sabine Sabrina Samuel Sandra Sara Sarah Sascha Sebastian Siegfried Sigrid Silke Silvia Simon Simone Sofia Sonja Sophia Sophie Stefan Stefanie Steffen Stephan Susanne Sven Svenja Swantje Sylvia Tanja Tatjana Theo Theodor Theresa Thilo "
    "Thomas Thorsten Tim Tina Timo Tobias Tom Torben Torsten Traute Udo Ulf Ulla Ulrich Ulrike Ursula Uta Ute Uwe Valentin Vanessa Vera Verena Veronika Viktor Viktoria Volker Volkmar Waltraud Walter Walther Wendelin Werner Wiebke Wilfried "
    "Wilhelm Willi Wolf Wolfgang Yannick Yvonne",
    "fr": "Adèle Adeline Adrien Agathe Agnès Alain Alban Albert Alexandra Alexandre Alexis Alice Aline Alix Amandine Ambre Amélie Anaïs André Andrée Angèle Anne Annick Annie Anthony Antoine Antoinette Arlette Armand Arnaud Arthur Audrey Aurélie "
    "Aurélien Aurore Axel Baptiste Bastien Béatrice Benjamin Benoît Bernadette Bernard Bertrand Blandine Brigitte Bruno Camille Carole Caroline Catherine Cécile Cédric Céline Chantal Charles Charlène Charlotte Chloé Christelle Christian "
    "Christiane Christine Christophe Claire Claude Claudine Clara Clarisse Clément Clémence Clémentine Clotilde Colette Coralie Corentin Corinne Cyril Cyrille Damien Daniel Daniele Danièle Danielle David Delphine Denis Denise Didier Dominique "
    "Dorian Édith Edouard Édouard Éliane Eliane Élise Elise Élodie Elodie Eloïse Émilie Emilie Emma Emmanuel Emmanuelle Enzo Éric Eric Estelle Esther Ethan Étienne Etienne Eugène Eugénie Eva Ève Évelyne Evelyne Fabien Fabienne Fabrice Fanny "
    "Félix Fernand Flavie Florence Florent Florian France Francine Francis Franck François Françoise Frédéric Frédérique Gabriel Gabrielle Gaël Gaëlle Gaston Gautier Geneviève Georges Gérald Gérard Germaine Ghislaine Gilbert Gilles Ginette "
    "Gisèle Grégoire Grégory Guillaume Gustave Guy Gwenaëlle Hélène Henri Henriette Hervé Honoré Hubert Hugo Hugues Inès Irène Isabelle Ismaël Jacqueline Jacques Jade Jean Jeanne Jeannine Jérémie Jérémy Jérôme Joël Joëlle Johan Jonathan "
    "Joseph Josette Josiane Jules Julia Julie Julien Juliette Justine Karim Karine Katia Kévin Laetitia Lætitia Laura Laure Laurence Laurent Léa Léo Léon Léonie Liliane Lina Lionel Lise Loïc Lola Louis Louise Luc Lucas Lucie Lucien Lucienne "
    "Lucile Ludovic Lydie Madeleine Maël Magali Manon Marc Marcel Marcelle Margaux Margot Marguerite Marie Marine Marion Marius Marlène Marthe Martine Mathieu Mathilde Mathis Matthieu Maurice Maxime Mélanie Mélissa Michel Michèle Micheline "
    "Mickaël Mireille Monique Morgane Muriel Mylène Myriam Nadège Nadia Nadine Nathalie Nathan Nicolas Nicole Ninon Noé Noémie Océane Odette Odile Olivier Pascal Pascale Patrice Patricia Patrick Paul Paulette Pauline Philippe Pierre Quentin "
    "Rachid Raoul Raphaël Raphaëlle Raymond Raymonde Régine Régis Rémi Rémy Renaud René Renée Richard Robert Roger Roland Romain Romane Roméo Rosalie Roxane Sabine Sabrina Salomé Samuel Sandra Sandrine Sarah Sébastien Serge Séverine Simon Simone "
    "Solange Solène Sonia Sophie Stéphane Stéphanie Suzanne Sylvain Sylvie Tanguy Thérèse Théo Thibault Thibaut Thierry Thomas Timothée Tristan Ulysse Valentin Valentine Valérie Véronique Victor Victoire Vincent Violette Virginie Viviane "
    "Xavier Yann Yannick Yasmine Yohan Yolande Yves Yvette Yvonne Zoé",
    "es": "Abel Adela Adolfo Adrián Adriana Agustín Agustina Ainhoa Aitana Aitor Alba Alberto Alejandra Alejandro Alejo Alexia Alfonso Alfredo Alicia Almudena Álvaro Amalia Amparo Ana Anabel Andrea Andrés Ángel Ángela Ángeles Aníbal Antonia Antonio "
    "Araceli Arturo Asunción Aurora Beatriz Belén Benito Berta Blanca Borja Bruno Camila Carla Carlos Carlota Carmela Carmen Carolina Catalina Cecilia César Clara Claudia Claudio Concepción Consuelo Cristian Cristina Cristóbal Daniel Daniela "
    "Darío David Diana Diego Dolores Domingo Eduardo Elena Elías Elisa Eloísa Elvira Emilia Emilio Encarnación Enrique Erika Ernesto Esperanza Esteban Esther Estefanía Eugenia Eugenio Eulalia Eva Fabián Fátima Federico Felipe Félix Fernanda "
    "Fernando Fermín Francisca Francisco Gabriel Gabriela Gerardo Germán Gloria Gonzalo Graciela Gregorio Guadalupe Guillermo Gustavo Héctor Hernán Hugo Ignacio Iker Inés Inmaculada Irene Isabel Isidoro Isidro Ismael Iván Jacinto Jaime Javier "
    "Jerónimo Jesús Jimena Joaquín Joaquina Joel Jordi Jorge José Josefa Josefina Juan Juana Julia Julián Juliana Julieta Julio Laura Leandro Leire Leonardo Leonor Leticia Lidia Lola Lorena Lorenzo Lourdes Lucas Lucía Luciano Luis Luisa Luz "
    "Macarena Magdalena Manuel Manuela Marc Marcela Marcelo Marcos Margarita María Mariana Mariano Maribel Marina Mario Marisa Marisol Marta Martina Martín Mateo Matías Matilde Mauricio Maximiliano Mercedes Micaela Miguel Milagros Miriam Míriam "
    "Mónica Montserrat Nadia Natalia Nerea Nicolás Noelia Nuria Octavio Olga Óscar Oscar Pablo Paloma Paola Patricia Patricio Paula Paulina Pedro Pilar Rafael Rafaela Ramiro Ramón Raquel Raúl Rebeca Ricardo Roberto Rocío Rodolfo Rodrigo Rogelio "
    "Rosa Rosalía Rosario Rubén Salvador Samuel Sandra Santiago Santos Sara Sebastián Sergio Silvia Simón Sofía Soledad Sonia Susana Tamara Teodoro Teresa Tomás Trinidad Unai Úrsula Valentina Valeria Vanesa Verónica Vicente Víctor Victoria "
    "Virginia Ximena Yolanda",
    "other": "Abdul Abdullah Aditya Agnieszka Ahmed Ahmet Aiko Aisha Akira Aleksandar Aleksandra Alessandra Alessandro Alessia Ali Amina Amir Amit Anders Andrzej Anil Anouk Anton Antonella Anya Aoife Arjun Arun Aslı Astrid Ayşe Bartosz Bogdan Bram "
    "Carlo Chiara Ciarán Ciara Chiamaka Chidi Chinedu Daan Daria Deepak Dimitri Dmitri Dorota Edoardo Elif Emeka Emre Eoin Ewa Fatima Fatma Femke Filip Francesca Francesco Giorgio Giovanna Giovanni Giulia Giuseppe Goran Grzegorz Hamza Haruto Hasan "
    "Hassan Hiroshi Ibrahim Igor Ingrid Irina Ivan Ivana Íñigo Jarek Jasper Jelena Jeroen Joanna Johan João Joost Jorge Kamil Katarzyna Kateryna Kemal Kenji Khalid Kofi Krzysztof Kwame Lorcan Leticia Lorenzo Luigi Luca Maciej Magnus Małgorzata Marek "
    "Marcin Marla Marta Mateusz Matteo Mehmet Mei Michał Mikael Mikhail Milan Miroslav Mustafa Nguyen Niamh Nikola Nikolai Ngozi Noor Olga Olena Oleksandr Omar Oksana Paolo Pavel Piet Pieter Piotr Priya Pooja Rahul Rajesh Ravi Riccardo Roberto Rohan "
    "Saoirse Sandeep Sanjay Sergei Siobhán Stellan Stefano Sunil Sunita Sunniva Svetlana Takashi Tamsin Tatiana Thea Tomasz Tunde Vikram Vladimir Wei Willem Xiao Yara Yuki Yusuf Zainab Zeno Zofia",
}
BY_LANGUAGE = {language: frozenset(names.split()) for language, names in _NAMES.items()}
COMMON = frozenset().union(*BY_LANGUAGE.values())
